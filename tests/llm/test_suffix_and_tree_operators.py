"""Runs, repeated byte strings and the manifest, against brute force and their SQL."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cohortwave.llm import merkle, periodic_runs, queries, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _runs int, _Kept string, _slice int, _rank int, _digest string"
CLASH = (7, "kept", 1, 2, "d")


def _rows():
    rng = random.Random(5)
    words = ["the", "of", "and", "ab", "été", "lorem", "Upper"] + [f"w{k}" for k in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line = "All rights reserved by the owners of this text and of all its copies."
    base = [text(rng.randrange(5, 150)) for _ in range(40)]
    texts = [None, "", " \n\t ", "one", "a" * 3000, "a" * 60, "a" * 49, "ab" * 900, "b" + "ab" * 80, "é" * 120, "é" * 30, "x y " * 40, "q " + "z " * 23, "z " * 24, base[0], base[0], text(9000)]
    for k in range(60):
        a, b = rng.choice(base), rng.choice(base)
        unit = [rng.choice(words[: rng.choice((1, 2, 9))]) for _ in range(rng.randrange(1, 20))]
        texts.append(a[rng.randrange(len(a)) :][: rng.randrange(300)] + text(rng.randrange(30)) + rng.choice(("", line)) + b[: rng.randrange(200)] + " " + " ".join(unit * rng.randrange(9)) + rng.choice(("", line)) + text(4))
    texts += base
    ids = [None if k % 17 == 0 else rng.randrange(-50, 10**12) for k in range(len(texts))]
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else ("b", "a", "é", "Z")[k % 4], None if k % 3 else len(t or ""), *CLASH) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return [*rows, rows[20], rows[20], rows[21], (None, None, None, None, None, *CLASH), (rows[21][0], "other text of that id", "fr", "lone", 1, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_runs(words):
    """Stretches of equal words at each distance, one distance after the other."""
    ids, least = {}, {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], int)
    for p in range(1, len(w) // 3 + 1):
        steps = np.diff(np.concatenate(([False], w[p:] == w[:-p], [False])).astype(int))
        for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True):
            if b - a + p >= max(24, 3 * p):
                least.setdefault((int(a), int(b - a) + p), p)
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force(docs, nothing):
    found = periodic_runs.collapse_runs(docs)
    assert found.columns == [*docs.columns, "__runs", "_collapsed"]
    many = 0
    for r in found.collect():
        words = r.text.encode().split() if r.text else []
        want = _plain_runs(words)
        assert [tuple(x) for x in r["__runs"]] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["_collapsed"] == (None if r.text is None else b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
        many += len(want)
    assert many > 20 and found.count() == docs.count() and periodic_runs.collapse_runs(nothing).count() == 0


def test_runs_of_few_words_and_many_periods():
    rng = random.Random(2)
    for _ in range(40):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            w = [str(rng.randrange(rng.choice((1, 2, 3, 30)))) for _ in range(rng.choice((0, 5, 23, 24, 30, 200)))]
            for _ in range(rng.randrange(4)):
                unit, at = [str(rng.randrange(rng.choice((1, 2, 50)))) for _ in range(rng.randrange(1, 30))], rng.randrange(len(w) + 1)
                w[at:at] = unit * rng.randrange(1, 12) + unit[: rng.randrange(len(unit))]
            texts.append(" ".join(w).encode())
        assert [r for r, _ in periodic_runs.runs_of_texts(texts)] == [_plain_runs(t.split()) for t in texts]
    assert periodic_runs.runs_of_texts([b"a " * 200_000]) == [([(0, 200_000, 1)], b"a")]
    assert len(periodic_runs.runs_of_texts([b" ".join(b"%d " % i + b"a " * 300 for i in range(200))])[0][0]) == 200


def test_pairs_of_equal_left_words_are_none():
    left = np.array([0, 1, 1, 1, 1])
    places, lcps = np.array([4, 3, 2, 1]), np.array([0, 16, 17, 18])
    assert periodic_runs.maximal_pairs(places, lcps, left) == []
    left[4] = 2
    assert sorted(periodic_runs.maximal_pairs(places, lcps * 2, left)) == [(1, 35, 3), (2, 34, 2), (3, 33, 1)]


def _plain_repeats(rows):
    ids = [suffix_dedup.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for i, (_, t) in zip(ids, rows, strict=True):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    out = Counter()
    for i, (d, t) in zip(ids, rows, strict=True):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[d, t, None if t is None else bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), spans] += 1
    return out


@pytest.mark.parametrize(("slice_bytes", "bucket"), [(8 << 20, 200_000), (9_000, 150), (5_000, 1)])
def test_repeated_strings_equal_brute_force(docs, nothing, slice_bytes, bucket):
    # a bucket of 1 makes every repeated anchor a very frequent one, whose windows go singly
    found = suffix_dedup.remove_repeated_strings(docs, slice_bytes=slice_bytes, bucket=bucket)
    assert found.columns == [*docs.columns, "__kept", "_removed", "_spans"]
    got = Counter((r.doc_id, r.text, None if r["__kept"] is None else bytes(r["__kept"]), r["_removed"], r["_spans"]) for r in found.collect())
    assert got == _plain_repeats([r[:2] for r in _rows()])
    assert sum(k[3] for k in got) > 5_000
    assert suffix_dedup.remove_repeated_strings(nothing).count() == 0


def test_stretches_cover_each_window_once_whatever_is_hashed_at_once(monkeypatch):
    texts = [t.encode() if t is not None else None for _, t, *_ in _rows()]
    whole = suffix_dedup.Slice(np.arange(len(texts)), texts)
    windows = {int(s) + d for s, n in zip(whole.start, whole.many, strict=True) for d in range(n)}
    assert len(windows) == whole.many.sum() == sum(max(0, len(t or b"") - 49) for t in texts)
    assert whole.many.max() <= suffix_dedup.MOST - suffix_dedup.SPAN + 1
    for chunk in (100, 257):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        again = suffix_dedup.Slice(np.arange(len(texts)), texts)
        assert all((getattr(again, k) == getattr(whole, k)).all() for k in ("start", "many", "key", "doc"))


def test_equal_hashes_do_not_make_equal_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mixed", np.zeros_like)
    own = suffix_dedup.Slice(np.arange(3), [f"{i} ".encode() * 20 + b"a passage of some length, word for word" for i in range(3)])
    which, first, _ = own.distinct(np.array([0, 1, 0]), np.array([50, 50, 50]), np.array([3, 2, 1]))
    assert which[0] == which[2] != which[1] and sorted(first.tolist()) == [1, 2]


def _plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _sha(*[field(r[c]) for c in merkle.FIELDS])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([_sha(*below[i : i + 16]) for i in range(0, len(below), 16)])
        return levels

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in by[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = Counter()
    for n, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            sides = []
            for levels, j in ((trees[k], i), (top, n)):
                for level in levels[:-1]:
                    first = j // 16 * 16
                    sides.append(("".join(level[first:j]), "".join(level[j + 1 : first + 16])))
                    j //= 16
            shown = dict(r)
            if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                shown["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            root = leaf(shown)
            for a, b in sides:
                root = _sha(a, root, b)
            out[r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], _sha(*[a + b for a, b in sides]), root, root == top[-1][0]] += 1
    return out


@pytest.mark.parametrize(("records", "rank_rows"), [(8_000, 8_000), (0, 20)])
def test_manifest_equals_brute_force(spark, docs, tmp_path, monkeypatch, records, rank_rows):
    # no records by broadcast, and ranks over many ranges, in the second case
    monkeypatch.setattr(merkle, "RECORDS", records)
    monkeypatch.setattr(merkle, "RANK_ROWS", rank_rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = _plain_manifest([r.asDict() for r in docs.collect()])
    assert Counter(map(tuple, merkle.op13_merkle_manifest(spark, str(tmp_path)).collect())) == want
    assert 0 < sum(n for k, n in want.items() if not k[-1]) < docs.count() / 4


def test_manifest_of_one_row_and_none(spark, nothing, tmp_path):
    one = spark.createDataFrame([(1, "T", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    nothing.write.parquet(f"{tmp_path}/none/documents.parquet")
    (row,) = merkle.op13_merkle_manifest(spark, f"{tmp_path}/one").collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == _sha("1:1", "-", "-", "1:1", "1:T") and row.proof_sha256 == _sha() and row.verified
    assert merkle.op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


def test_requests_for_some_leaves_get_their_proofs_alone(docs):
    made = merkle.manifest(docs)
    some = made.leaves.where("_rank % 7 = 3").select("_tree", "_rank", "_digest").withColumnRenamed("_digest", "asked")
    found = made.prove(some).collect()
    assert len(found) == some.count() and all(r.asked == r["_digest"] for r in found)
    assert sum(merkle_sides(r["_path"]) for r in found) > 0


def merkle_sides(path):
    return sum(len(s.l + s.r) // merkle.DIGEST for s in path)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_suffix_dedup", "op13_merkle_manifest"])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, small)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
