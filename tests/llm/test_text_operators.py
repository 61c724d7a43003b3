"""Each corpus operator against brute force, on texts with every awkward case."""

import base64
import hashlib
import heapq
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortwave.llm import ann, decontamination, language_id, line_dedup, mixing, near_dedup, quality, sharding, token_counts, warc
from cohortwave.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, _score double"
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _rows():
    rng = random.Random(3)
    texts = [_text(rng, rng.randrange(5, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " extra", texts[2].upper(), None, "", "  \n\t ", "one", "two words", "x" * 30_000, _text(rng, 9_000), "!!! ??? 123", "\n".join(_text(rng, 8) for _ in range(40))]
    texts += [texts[-1] + "\nfresh ending line here", "lead line\n" + texts[-1]]
    rows = [(i, t, None if i % 11 == 0 else ("en", "fr")[i % 2], None if i % 13 == 0 else f"src{i % 3}", len(t or ""), 7, "clash", 0.5) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "a row without an id", "en", "src0", 5, 1, "s", 0.1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates_equal_brute_force(docs, nothing):
    found = near_dedup.near_duplicates(docs).toPandas()
    prints = {}
    for i, t, *_ in _rows():
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints[i, t] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    values = sorted(set(prints.values()))
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    least = {r: min((i for (i, _), v in prints.items() if root[v] == r and i is not None), default=None) for r in set(root.values())}
    expected = Counter((i, prints[i, t], least[root[prints[i, t]]]) for i, t, *_ in _rows())
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), int(r.print) & (1 << 64) - 1, None if np.isnan(r.component_id) else int(r.component_id)) for r in found.itertuples())
    assert got == expected
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_large_shards_are_cut_and_lose_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(150)})
    frame = spark.createDataFrame([(v,) for v in values], "print long")
    for part in (1000, 60):
        links = near_dedup.fingerprint_links(frame, part=part).toPandas()
        root = {v: v for v in values}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links.itertuples(index=False):
            root[find(a)] = find(b)
        for i, a in enumerate(values):
            for b in values[:i]:
                if (a ^ b).bit_count() <= 3:
                    assert find(a) == find(b)


def test_deduplicate_keeps_one_of_each_group(spark, docs, nothing):
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = near_dedup.near_duplicates(docs).toPandas()
    assert sorted(i for i in ids if i is not None) == sorted({int(c) for c in groups.component_id.dropna()})
    assert near_dedup.deduplicate(nothing).count() == 0
    rng = random.Random(9)
    a, b, c, d, e = (_text(rng, 40) for _ in range(5))
    rows = [(3, b), (5, a), (5, b), (5, c), (5, c), (None, c), (None, d), (None, d), (None, e), (7, e)]
    found = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter([(3, b), (5, a), (5, c), (None, d), (7, e)])


def test_trees_do_the_search_and_their_size_changes_nothing(spark, small):
    texts = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/documents.parquet").select("text")
    values = np.unique([r[0] for r in texts.select(near_dedup.fingerprint_column(F.col("text"), 3)).collect()])
    masks = near_dedup.block_masks(0)
    assert sum(masks) == (1 << 64) - 1 and all(near_dedup._head(m, 2).bit_count() == 2 for m in masks)
    width = max(0, math.ceil(math.log2(len(values) / near_dedup.TREE)))
    sizes = [n for m in masks for n in Counter(int(v) & near_dedup._head(m, width) for v in values.view(np.uint64).tolist()).values()]
    assert np.median(sizes) > 100
    frame = spark.createDataFrame([(int(v),) for v in values], "print long").cache()
    found = set()
    for how in ({}, {"width": 0, "part": 100_000}, {"width": 6, "part": 60}):
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in near_dedup.fingerprint_links(frame, **how).toPandas().itertuples(index=False):
            root[find(a)] = find(b)
        groups = {}
        for v in list(root):
            groups.setdefault(find(v), set()).add(v)
        found.add(frozenset(map(frozenset, groups.values())))
    assert len(found) == 1 and next(iter(found))


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(0)
    prints = np.unique((rng.integers(0, 1 << 63, 400).astype(np.uint64) & np.uint64(0xFFFF)) | np.uint64(7 << 40))
    got = {(m, int(q)) for m, hits in near_dedup.BKTree(prints, np.arange(len(prints))).search(prints, np.arange(len(prints)), 3) for q in hits}
    assert got == {(i, j) for i in range(len(prints)) for j in range(len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}


def test_language_edges_and_accuracy(spark, docs, nothing, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.learn(table.where(~held_out("doc_id")))
    test = language_id.identify(table.where(held_out("doc_id")), model).toPandas()
    assert (test["_language"].map(lambda r: r["lang"]) == test["lang"]).mean() > 0.95
    found = language_id.identify(docs, model)
    assert set(docs.columns) < set(found.columns)
    for r in found.collect():
        assert 0 <= r["_language"]["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["_language"]["lang"], r["_language"]["score"], r["_language"]["accepted"]) == ("und", 0.0, False)
    assert language_id.identify(nothing, model).count() == 0
    assert language_id.learn(nothing).predict("some words")[:2] == ("und", 0.0)


@pytest.mark.parametrize("languages", [("en", "fr"), ("de", "en", "es"), ("de", "en", "es", "fr")])
def test_foreign_and_junk_texts_are_rejected_and_mixtures_stay(spark, small, languages):
    table = spark.read.parquet(f"{small}/documents.parquet").where(F.col("lang").isin(*languages))
    model = language_id.learn(table.where(~held_out("doc_id")))
    rng = random.Random(4)
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(60))
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心"]
    for text in [junk, "a" * 500, *[3 * (t + " ") for t in foreign]]:
        assert not model.predict(text)[2]
    held = [r for r in table.where(held_out("doc_id")).collect() if any(c.isalpha() for c in r.text or "")]
    texts = [r.text for r in held] + [a.text + "\n" + b.text for a, b in zip(held, held[1:], strict=False) if a.lang != b.lang]
    assert np.mean([model.predict(t)[2] for t in texts]) > 0.98


def test_subword_counts_equal_plain_ones():
    for text in ("Größe, déjà-vu 42 a", "  x ", "ab1cd", "no\nline"):
        plain = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            marked = [0, *map(ord, word), 0]
            for n in language_id.ORDERS:
                for part in (marked[i : i + n] for i in range(len(marked) - n + 1)):
                    h = part[0] * 0x9E3779B1 % 2**32
                    for k, c in enumerate(part[1:], 2):
                        h = ((h ^ c) * 0x85EBCA6B + k) % 2**32
                    plain[h >> 19] += 1
        got = language_id.subword_counts(text)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(plain)


def test_quality_score_equals_plain_compression(spark, small):
    table, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.learn(table, labels.where(~held_out("doc_id")))
    for r in quality.score(table.limit(60), model).collect():
        body = (r["text"] or "").encode()
        size = [sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(body[a : a + quality.PIECE])) for a in range(0, len(body), quality.PIECE)) for d in (model.good, model.bad)]
        z = model.curve[0] + model.curve[1] * ((size[1] - size[0]) / math.sqrt(len(body)) if body else 0)
        assert r["_quality"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_subword_blocks_do_not_change_counts(monkeypatch):
    text = "Größe und Länge, élève déjà vu " * 50
    whole = language_id.subword_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 64)
    assert (language_id.subword_counts(text) == whole).all()


def test_quality_separates_and_handles_edges(spark, docs, nothing, small):
    table, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.learn(table, labels.where(~held_out("doc_id")))
    held = quality.score(table, model).join(labels, "doc_id").where(held_out("doc_id")).toPandas()
    good, bad = held[held.quality == 1]["_quality"], held[held.quality == 0]["_quality"]
    if len(good) and len(bad):
        assert np.mean([g > b for g in good for b in bad]) > 0.7
    scores = [r["_quality"] for r in quality.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(nothing, model).count() == 0
    assert quality.learn(docs, labels.limit(0)).score(b"text") == 0.5


@pytest.mark.parametrize("data", ["edges", "small", "empty"])
def test_mixing_equals_sql(spark, docs, nothing, small, data, tmp_path):
    if data == "small":
        folder = small
    else:
        folder = str(tmp_path)
        (docs if data == "edges" else nothing).write.parquet(f"{folder}/documents.parquet")
    got = mixing.op4_source_mixing(spark, folder).toPandas()
    con = duckdb.connect()
    pattern = f"{folder}/documents.parquet" + ("" if data == "small" else "/*.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{pattern}'")
    rows = con.sql(mixing.OP4_SQL).fetchall()
    key = lambda r: tuple("" if v is None or v != v else round(float(v), 6) for v in r)
    assert Counter(map(key, got.itertuples(index=False, name=None))) == Counter(map(key, rows))
    assert (got["taken"] <= 2 * got["size"]).all()


def test_mix_repeats_rows(docs, nothing):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(docs)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))


#: Every name that an operator uses inside, or gives to a result, and some that need quoting.
NAMES = """_size _key _place _places _source _bin _bins _end _last _epochs _copies source_size target _row _id _doc _version _v _at _text _spans
_runs _run _cut _removed _language _quality _tokens _crc _shard _slot _part _start _within _lang _group _node size shard slot text_crc32 law print
first n none version component_id mask kept root hash at lines body often salt _salt _hot m item_id similarity a.b odd`name""".split()


def test_columns_of_any_name_come_out_as_they_went_in(spark, docs, small):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    pieces, model = token_counts.Pieces({"a": -1.0}, -9.0), language_id.learn(spark.read.parquet(f"{small}/documents.parquet").where(~held_out("doc_id")))
    runs = {name: lambda df, stage=stage: stage(spark, df, small) for name, stage in corpus_pipeline.STAGES if name != "language_id"}
    runs |= {
        "accepted": lambda df: language_id.accepted(df, model),
        "identify": lambda df: language_id.identify(df, model),
        "tokens": lambda df: token_counts.count_tokens(df, pieces),
        "lines": lambda df: line_dedup.remove_repeats(df, line_dedup.passages),
        "quality": lambda df: quality.score(df, quality.QualityModel(b"", b"", np.zeros(2))),
    }
    for name, run in runs.items():
        want, got = run(plain), run(odd)
        assert got.columns[: len(odd.columns)] == odd.columns
        new = len(got.columns) - len(odd.columns)
        assert new == len(want.columns) - len(plain.columns) and len(set(map(str.lower, got.columns))) == len(got.columns)
        rows = got.collect()
        assert rows and all(r[len(plain.columns) + i] == f"own {n}" for r in rows for i, n in enumerate(NAMES))
        part = lambda r, n=new: str((*r[:5], *(r[len(r) - n :] if n else ())))
        assert Counter(map(part, rows)) == Counter(map(part, want.collect())), name


def test_targets_refill_what_caps_free(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    target = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert sum(target.values()) == pytest.approx(1.5 * 2015)
    assert target["a"] == 20 and target[None] == 10
    assert target["c"] / target["b"] == pytest.approx(2) or target["c"] == 2000


def test_sharding_law_and_slots(docs, nothing, spark, small):
    for frame in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = sharding.shard(frame, 5).toPandas()
        assert len(got) == frame.count()
        sums = got.groupby("_shard")["_size"].sum()
        assert sums.max() - sums.min() <= 2.2 * got["_size"].max()
        for _, own in got.groupby("_shard"):
            assert sorted(own["_slot"]) == list(range(len(own)))
    assert sharding.shard(nothing, 5).count() == 0
    assert sharding.shard(docs, target_bytes=50_000).select("_shard").distinct().count() > 1


def test_sharding_equals_brute_force(spark, docs, small):
    for frame, leaves in ((spark.read.parquet(f"{small}/documents.parquet"), 13), (docs, 4)):
        narrow, _, tree = sharding._grown(frame, leaves, 0)
        rows = narrow.withColumn("shard", tree.shard()).collect()

        def split(own, node, rows=rows, tree=tree):
            """Every split is along the widest dimension and at the place nearest to its share of the bytes."""
            if tree.many[node] < 2:
                assert all(r["shard"] == tree.first[node] for r in own)
                return
            low = [r for r in own if r["_places"][tree.axis[node]] < tree.cut[node]]
            high = [r for r in own if r["_places"][tree.axis[node]] >= tree.cut[node]]
            if own:
                wide = [max(r["_places"][a] for r in own) // 2**32 - min(r["_places"][a] for r in own) // 2**32 for a in range(3)]
                assert tree.axis[node] == wide.index(max(wide))
                order = sorted((r["_places"][tree.axis[node]], r["_size"]) for r in own)
                goal, held = sum(s for _, s in order) * (tree.many[node] // 2) / tree.many[node], 0
                best = math.inf
                for i, (p, size) in enumerate(order):
                    if not i or p != order[i - 1][0]:
                        best = min(best, abs(goal - held))
                    held += size
                best = min(best, abs(goal - held))
                miss = abs(goal - sum(r["_size"] for r in low))
                assert miss <= max(best, sharding.TOLERANCE * sum(r["_size"] for r in rows) / leaves) + 1e-6
            split(low, 2 * node + 1)
            split(high, 2 * node + 2)

        split(rows, 0)


def test_equal_texts_share_a_shard_whatever_their_source(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    again = table.where("doc_id % 10 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    got = sharding.shard(table.union(again), 6).groupBy("text").agg(F.countDistinct("_shard").alias("n")).toPandas()
    assert (got["n"] > 1).sum() <= 5  # a cut may fall into a group: five cuts for six shards


def test_equal_copies_can_be_cut(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sums = sharding.shard(frame, 8).groupBy("_shard").sum("_size").toPandas()["sum(_size)"]
    assert len(sums) == 8 and sums.max() < 1.1 * sums.mean()


def test_contamination_equals_brute_force(spark, docs, nothing):
    rng = random.Random(5)
    items = [(1, _text(rng, 40)), (2, _text(rng, 15)), (3, "two three"), (4, None), (5, ""), (6, _text(rng, 60))]
    w = items[5][1].split()
    near = " ".join([*w[:58], "other", "end"])
    texts = [(100, _text(rng, 30) + " " + items[0][1].upper() + " " + _text(rng, 10)), (101, items[1][1].replace(" ", "\n")), (102, "say two three now"), (103, near), (104, _text(rng, 200)), (105, items[0][1][:100])]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.at, round(r.similarity, 9)) for r in decontamination.contaminated(frame, bench).collect()}
    expected = {}
    for r in frame.collect():
        have = (r.text or "").lower().split()
        for item, text in items:
            want = (text or "").lower().split()
            n = min(5, len(want))
            b = Counter(zip(*(want[i:] for i in range(n)), strict=False)) if want else Counter()
            for at in range(len(have) - len(want) + 1) if want else ():
                part = have[at : at + len(want)]
                a = Counter(zip(*(part[i:] for i in range(n)), strict=False))
                both = sum((a & b).values())
                alike = both / (a.total() + b.total() - both)
                if alike >= 0.8 and alike > expected.get((r.doc_id, item), (0, 0))[1] + 1e-12:
                    expected[r.doc_id, item] = (at, round(alike, 9))
    assert got == expected and {(100, 1), (101, 2), (102, 3), (103, 6)} <= set(got)
    clean = {r.doc_id for r in decontamination.decontaminate(frame, bench).collect()}
    assert clean == {r.doc_id for r in frame.collect()} - {d for d, _ in got}
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(frame, bench.limit(0)).count() == frame.count()


def test_windows_recall_on_whole_tables(spark, small):
    table, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    rng = random.Random(6)
    texts = {r.doc_id: (r.text or "").lower().split() for r in table.collect()}
    bench = {r.item_id: r.text.lower().split() for r in items.collect()}
    edited = {}
    for n, (item, words) in enumerate(bench.items()):  # each item with some words exchanged, in the middle of other text
        own = list(words)
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = "exchanged"
        edited[100_000 + n] = [*_text(rng, 30).split(), *own, *_text(rng, 30).split()]
        edited[200_000 + n] = words[: len(words) - rng.randrange(1, 6)]  # a text shorter than its item
    frame = table.select("doc_id", "text").union(spark.createDataFrame([(i, " ".join(w)) for i, w in edited.items()], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(frame, items).collect()}
    expected, seen = {}, {}
    for item, words in bench.items():
        for g in zip(*(words[i:] for i in range(5)), strict=False):
            seen.setdefault(g, set()).add(item)
    for doc, words in (texts | edited).items():
        near = {i for g in zip(*(words[k:] for k in range(5)), strict=False) for i in seen.get(g, ())}
        for item in near:
            b = Counter(zip(*(bench[item][i:] for i in range(5)), strict=False))
            size = min(len(words), len(bench[item]))
            for at in range(len(words) - size + 1):
                a = Counter(zip(*(words[at : at + size][i:] for i in range(5)), strict=False))
                both = sum((a & b).values())
                alike = both / (a.total() + b.total() - both)
                if alike >= 0.8:
                    expected[doc, item] = max(alike, expected.get((doc, item), 0))
    assert set(got) <= set(expected) and len(set(got) & set(expected)) >= 0.9 * len(expected)
    assert all(0.8 <= s <= expected[k] + 1e-9 for k, s in got.items())
    assert np.mean([s == pytest.approx(expected[k]) for k, s in got.items()]) >= 0.9
    assert sum(k[0] >= 200_000 for k in got) > 10


def test_token_counts_equal_plain_dynamic_programming(docs, nothing):
    pieces = token_counts.Pieces({"▁": -9.0, "▁the": -1.0, "▁t": -4.0, "he": -2.0, "the": -3.0, "h": -5.0, "e": -5.0, "t": -5.0, "o": -5.0, "of": -2.0, "f": -5.0, "▁of": -1.5, "an": -2.5, "a": -5.0, "n": -5.0, "d": -5.0, "and": -2.0}, -30.0)

    def brute(text):
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 5), end):
                part = text[start:end]
                score = pieces.scores.get(part)
                many = 1
                if score is None and len(part) == 1:
                    score, many = pieces.unknown, len(part.encode())
                if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                    best[end] = (best[start][0] + score, best[start][1] + many)
        return best[-1][1]

    got = token_counts.count_tokens(docs.where("length(text) < 2000 or text is null"), pieces).collect()
    assert got and all(r["_tokens"] == brute(r["text"]) for r in got)
    assert token_counts.count_tokens(nothing, pieces).count() == 0
    counter = token_counts.TokenCounter(pieces)
    odd = ["é the\n\nand  of ", "▁the", "漢", "\n", " "]
    assert counter.count(odd) == [brute(t.replace("▁", " ")) for t in odd]


def test_long_words_keep_one_state_and_count_alike(monkeypatch):
    pieces = token_counts.Pieces({"ab": -1.0, "a": -2.0, "b": -2.5, "▁": -3.0, "aba": -1.2}, -30.0)
    word = "abbaabab" * 400
    counter = token_counts.TokenCounter(pieces)
    got = counter.count([word, word + " ab", "x" * 3])
    assert not any(len(w) > token_counts.LONG for w in counter.spaced.counts)
    monkeypatch.setattr(token_counts, "LONG", 10**9)
    assert token_counts.TokenCounter(pieces).count([word, word + " ab", "x" * 3]) == got
    assert token_counts.TokenCounter(pieces).count(["ab" * 500_000]) == [500_001]


def test_scores_are_shares_of_the_files_own_pieces(spark, docs, nothing):
    import sentencepiece

    path = token_counts.default_vocabulary()
    with open(path, "rb") as file:
        model = file.read()
    given = sentencepiece.SentencePieceProcessor(model_proto=model)
    few = docs.where("length(text) < 3000 and text not like '%\n%'")
    want = Counter(p for r in few.collect() for w in (r.text.split(" ") if r.text else ()) for p in given.encode(w, out_type=str))
    assert token_counts.piece_counts(few, model) == dict(want)
    pieces = token_counts.Pieces.of(model, want)
    assert sum(math.exp(s) for s in pieces.scores.values()) == pytest.approx(1)
    assert len(set(token_counts.fit(nothing, path).scores.values())) == 1


def test_shared_prefixes_are_scored_once():
    pieces = token_counts.Pieces({c: -1.0 for c in "abc"}, -30.0)
    trie = token_counts.TrieCounter(pieces, "")
    steps = []
    plain = trie._step
    trie._step = lambda state, c: steps.append(c) or plain(state, c)
    trie.add({"abc", "abca", "abcb"})
    assert len(steps) == 5 and trie.counts == {"abc": 3, "abca": 4, "abcb": 4}


def test_line_dedup_equals_brute_force(docs, nothing):
    rows = sorted({(i, t) for i, t, *_ in _rows() if i is not None and t is not None})
    count, first = Counter(), {}
    for i, t in rows:
        b = t.encode()
        for at, n, *_ in line_dedup.chunks(b):
            count[b[at : at + n]] += 1
            first.setdefault(b[at : at + n], (i, at))
    got = {(r.doc_id, r["_removed"], r.text) for r in line_dedup.remove_repeats(docs).collect() if r.doc_id is not None and r.text is not None}
    expected = set()
    for i, t in rows:
        b, out, at, gone = t.encode(), [], 0, 0
        for a, n, lines, _ in line_dedup.chunks(b):
            body = b[a : a + n]
            if count[body] > 1 and first[body] != (i, a):
                out.append(b[at:a])
                at, gone = a + n + 1, gone + lines
        whole = b"".join([*out, b[at:]])
        whole = whole[:-1] if at > len(b) and whole.endswith(b"\n") else whole
        expected.add((i, gone, whole.decode()))
    assert got == expected and any(g for _, g, _ in got)
    assert line_dedup.remove_repeats(docs).count() == docs.count()
    assert line_dedup.remove_repeats(nothing).count() == 0


def test_long_line_is_removed_wherever_it_stands(spark):
    line = " ".join(f"word{i}" for i in range(60))
    frame = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"c d\n{line}"), (3, line), (4, "short\nshort")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame).collect()}
    assert got == {1: f"a\n{line}\nb", 2: "c d", 3: "", 4: "short\nshort"}


def test_passages_equal_brute_force_over_runs(spark):
    rng = random.Random(8)
    pool = [_text(rng, rng.choice((3, 12, 25, 30, 55))) for _ in range(12)] + ["", "common"]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 7))] for _ in range(8)]
    texts = []
    for i in range(50):
        parts = [rng.choice(runs) if rng.random() < 0.5 else [rng.choice(pool) if rng.random() < 0.2 else f"{i} {k} " + _text(rng, 9)] for k in range(rng.randrange(2, 7))]
        texts.append("\n".join(line for part in parts for line in part))
    line = _text(rng, 30)
    texts += ["\n".join([line] * 7), "a b\n" + "\n".join([line] * 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r["_removed"]) for r in line_dedup.remove_repeats(frame, line_dedup.passages).collect()}
    seen, expected, late = {}, {}, 0
    for i, t in enumerate(texts):
        own, at, gone = t.split("\n"), {0: 0}, set()
        for k, x in enumerate(own):
            at[max(at) + len(x.encode()) + 1] = k + 1
        cuts = {(at[a], at[a] + n) for a, _, n, _ in line_dedup.chunks(t.encode())}
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(own[a:b])
                long = sum(len(x.split()) for x in run) >= 50 and run[0].split() and run[-1].split()
                if long or (a, b) in cuts:
                    where = seen.setdefault(run, (i, a, b))
                    if where[0] != i or a >= where[2]:
                        gone |= set(range(a, b))
                        late += (a, b) not in cuts
        expected[i] = ("\n".join(x for k, x in enumerate(own) if k not in gone), len(gone))
    assert got == expected and late


def test_loser_tree_merges_like_heapq():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 6, 9):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


def test_archives_round_trip(spark, tmp_path):
    odd = "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\nmore\r\n"
    pages = [(1, "http://b.example.com/x?b=2&a=1", "<p>é</p>"), (2, "http://b.example.com/X", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "https://www.a.example.org/", odd), (6, "http://a.example.org/", odd), (7, "http://[bad", "tail\r"), (8, "u", "\n\r\n"), (9, "u", "x" * 200_000), (9, "u", "x" * 200_000), (None, "n", "no id")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, refers_to int").repartition(3)
    got = warc.capture_history(frame, str(tmp_path / "warc")).toPandas()
    top = {}
    for i, _, html in pages:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    expected = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        to = top[html or ""]
        revisit = i is not None and i < to
        expected[str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", str(to) if revisit else "None"] += 1
    name = lambda v: "None" if v != v or v is None else str(int(v))
    assert Counter((name(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, name(r.refers_to)) for r in got.itertuples()) == expected
    keys = [(r.urlkey, r.captured) for r in got.itertuples()]
    assert keys == sorted(keys)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    again = warc.capture_history(frame, str(tmp_path / "again")).toPandas()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert again["captured"].tolist() == got["captured"].tolist() and got["captured"].max() == "2023-11-14T22:13:29Z"
    many = warc.merge_runs(warc.capture_runs(spark, str(tmp_path / "warc")), 2).toPandas()
    assert many[got.columns].equals(got) and many["record"].tolist() == got["record"].tolist()
    assert warc.url_key("http://b.example.com/x?b=2&a=1") == "com,example,b)/x?a=1&b=2"
    assert warc.capture_history(frame.limit(0), str(tmp_path / "none")).count() == 0


def test_vector_search(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    extra = [(9000 + i, [0.5] * 64) for i in range(60)] + [(9100, None), (9101, [0.0] * 64), (9102, [float("nan")] * 64), (9103, [1.0, 2.0]), (9104, [None] * 64), (9120, [float("inf")] * 64), (9140, [])]
    table = table.union(spark.createDataFrame(extra, "vec_id long, embedding array<float>"))
    got = ann.search(table, table.where("vec_id % 20 = 0")).toPandas()
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.vec_id < 9100}
    ids = np.array(sorted(rows))
    v = np.stack([rows[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = (v * rows[q]).sum(axis=1)
        best = [int(i) for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert all(abs(s - (rows[i] * rows[q]).sum()) < 1e-12 for i, s in zip(own.vec_id, own.score, strict=True))
        if q >= 9000:
            assert own.vec_id.tolist() == best
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 20
    assert hits / total >= 0.9
    twice = table.union(spark.createDataFrame([(7, [0.9] * 64), (7, [0.8] * 64), (20, [0.7] * 64), (20, [0.7] * 64)], "vec_id long, embedding array<float>"))
    again = ann.search(twice, twice.where("vec_id % 20 = 0")).toPandas()
    assert not again.duplicated(["query_id", "vec_id"]).any() and again.groupby("query_id").size().max() == 20
    few = table.where("vec_id < 6")
    assert ann.search(few, few).groupBy("query_id").count().toPandas()["count"].tolist() == [5] * 6
    assert ann.search(table.limit(0), table).count() == 0


def test_forget_deletes_what_was_written(spark):
    from cohortwave.llm import common

    frame = common.written(spark.range(3), "trial")
    assert frame.count() == 3
    path = common._PATHS[-1]
    common.forget(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_vector_search_of_mixed_lengths_and_small_clusters(spark):
    rng = np.random.default_rng(4)
    mixed = [(i, rng.normal(size=4 if i % 20 == 0 else 8).tolist()) for i in range(200)] + [(1000 + 20 * i, rng.normal(size=8).tolist()) for i in range(3)]
    table = spark.createDataFrame(mixed, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 20 = 0")).toPandas()
    assert sorted(set(got.query_id)) == [1000, 1020, 1040] and (got.groupby("query_id").size() == 20).all()
    # far clusters of five vectors: the cells that a query probes hold fewer than it asks for
    centres = rng.normal(size=(80, 16)) * 50
    rows = [(i, (centres[i // 5] + rng.normal(size=16)).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 20 = 0"), recall=0.05).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and len(set(got.query_id)) == 20


def test_page_ids_over_all_of_long(spark, tmp_path):
    ids = [-(1 << 63), -1, 0, 1, 3 * 10**11, 9 * 10**18, (1 << 63) - 1, (1 << 37) + 1]
    frame = spark.createDataFrame([(i, "http://a.example/", f"p{i}") for i in ids], "page_id long, url string, html string")
    got = warc.capture_history(frame, str(tmp_path / "all")).toPandas()
    assert sorted(got.page_id) == sorted(ids) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", t) for t in got.captured)
    assert list(zip(got.captured, got.page_id, strict=True)) == sorted(zip(got.captured, got.page_id, strict=True))


def test_items_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c = (_text(rng, 30) for _ in range(3))
    items = spark.createDataFrame([(None, a), (7, b), (7, c), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{_text(rng, 9)} {a} {b} {c}"), (2, b), (3, _text(rng, 60))], "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect())
    assert got == Counter([(1, None), (1, 7), (1, 7), (2, 7)])
    assert [r.doc_id for r in decontamination.decontaminate(docs, items).collect()] == [3]


def test_many_items_of_a_length_are_compared_by_lists():
    rng = np.random.default_rng(6)
    own = decontamination._Length(40)
    own.prints = rng.integers(0, 1 << 63, 5000).tolist()
    filed = np.array(own.prints, np.uint64)
    asked = filed[rng.integers(0, 5000, 3000)]
    for row, flips in enumerate(rng.integers(0, 20, 3000)):
        for bit in rng.choice(64, flips, replace=False):
            asked[row] ^= np.uint64(1 << int(bit))
    want = {(i, int(w)) for i, p in enumerate(filed) for w in np.flatnonzero(np.bitwise_count(asked ^ p) <= decontamination.RADIUS)}
    assert {(i, int(w)) for i, rows in own.near(asked) for w in rows} == want and len(want) > 2000
    assert sum(len(w) for w, _ in own.met(asked, own.passed(asked))) < 0.06 * 5000 * 3000
    few = decontamination._Length(40)
    few.prints = own.prints[:10]
    assert {(i, int(w)) for i, rows in few.near(asked) for w in rows} == {k for k in want if k[0] < 10}


@pytest.mark.parametrize("kind", ["null ids, own texts", "null ids, one text", "one id, own texts"])
def test_mix_meets_its_target_without_ids(spark, kind):
    rng = random.Random(15)
    same = _text(rng, 40)
    rows = [(None if "null" in kind else 5, same if "one text" in kind else _text(rng, 40), "a") for _ in range(500)] + [(10 + i, _text(rng, 40), "a") for i in range(100)] + [(1000 + i, _text(rng, 40), "b") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix(frame, weights=(1, 4), share=0.5)
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    sizes = spark.createDataFrame([("a", 24_000), ("b", 12_000)], "source string, source_size long")
    for r in mixing.source_targets(sizes, (1, 4), 0.5).collect():
        assert abs(taken[r.source] - r.target) <= 40
    assert Counter(map(tuple, mixing.mix(frame, weights=(1, 4), share=0.5).collect())) == Counter(map(tuple, mixed.collect()))


def test_a_cut_falls_beside_copies_that_are_a_small_part_of_a_shard(spark):
    rng = random.Random(23)
    rows, i = [], 0
    for _ in range(260):
        text = _text(rng, rng.randrange(20, 60))
        for _ in range(rng.choice((1, 1, 1, 2, 3))):
            rows.append((i, text, rng.choice(("en", "fr")), f"s{rng.randrange(3)}"))
            i += 1
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), 3).toPandas()
    assert (found.groupby("text")["_shard"].nunique() == 1).all() and found["text"].duplicated().sum() > 50
    sums = found.groupby("_shard")["_size"].sum()
    assert sums.max() < 1.1 * sums.min()


def test_words_of_all_sizes_have_their_xxh64():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(33, 256, n).astype(np.uint8)) for n in rng.permutation(np.repeat(np.arange(1, 70), 3))]
    assert decontamination._codes(words).tolist() == [xxh64_intdigest(w, 42) for w in words]
    assert len(decontamination._codes([])) == 0


@pytest.mark.parametrize("widths", [[1], [11, 12, 13, 15, 16, 31, 32, 33, 63, 64, 127], [1, 100, 101], [2, 40, 128, 300], [500]])
@pytest.mark.parametrize("many", [5, 130, 999])
def test_fingerprints_of_growing_widths_equal_those_of_running_sums(monkeypatch, widths, many):
    monkeypatch.setattr(decontamination, "STEP", 256)
    hashes = np.random.default_rng(4).integers(0, 1 << 64, many, np.uint64)
    hashes[20:60] = hashes[20:21]
    got = {}
    for at, own, prints in decontamination._windows(hashes, [decontamination._Length(w + 4) for w in widths]):
        got.setdefault(own.width, []).append((at, prints.copy()))
    assert set(got) == {w for w in widths if w <= many}
    for width, parts in got.items():
        assert [at for at, _ in parts] == [*range(0, many - width + 1, 256)]
        assert (np.concatenate([p for _, p in parts]) == decontamination._fingerprints(decontamination._running(hashes), width)).all()


def test_the_index_of_a_few_items_proposes_few_windows_and_all_near_ones():
    rng = np.random.default_rng(7)
    own = decontamination._Length(40)
    own.prints = rng.integers(0, 1 << 63, 5).tolist()
    filed, asked = np.array(own.prints, np.uint64), rng.integers(0, 1 << 64, 50_000, np.uint64)
    for row in range(0, 50_000, 50):
        asked[row] = filed[row % 5]
        for bit in rng.choice(64, row // 50 % 20, replace=False):
            asked[row] ^= np.uint64(1 << int(bit))
    near = np.flatnonzero((np.bitwise_count(asked[:, None] ^ filed) <= decontamination.RADIUS).any(axis=1))
    assert len(near) >= 800 and set(near) <= set(own.passed(asked))
    assert len(own.passed(asked)) < 0.05 * len(asked)
