"""Queries on filters and rates over blocks, each beside its SQL.

Recordings of the tables have some hundred samples, so blocks are short here: a
recording takes several, and what passes between them is put to the test.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import filters
from ..operators import scans
from ..sources.tables import EVENT_SAMPLES, LINE_SAMPLES, event_samples, line_samples
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Samples of a block.
BLOCK = 128
CHANNELS = 4
_BAND = (1.0, 16.0, 128.0)


def _filter_sql() -> str:
    """Forward and backward, one sample a step of the recursion, all recordings and channels side by side."""
    sections = filters.butterworth_band(*_BAND)
    pad = 6 * len(sections)
    cascade = filters.Cascade(sections)
    rest = cascade.rest(np.ones(1))[:, 0]
    number = lambda v: f"({float(v)!r}::DOUBLE)"
    states = [f"s{i}" for i in range(cascade.size)]

    def step(name: str, seq: str) -> str:
        first = ", ".join(f"v[1] * {number(r)} AS {s}" for r, s in zip(rest, states, strict=True))
        lines, x = [], f"q.v[{name}.k + 1]"
        for i, (b, a) in enumerate(sections):
            u, w = f"{name}.s{2 * i}", f"{name}.s{2 * i + 1}"
            lines += [f"{x} * {number(b[0])} + {u} AS y{i}", f"{x} * {number(b[1])} - y{i} * {number(a[1])} + {w} AS n{2 * i}", f"{x} * {number(b[2])} - y{i} * {number(a[2])} AS n{2 * i + 1}"]
            x = f"y{i}"
        named = ", ".join(f"n{i} AS s{i}" for i in range(cascade.size))
        # the first step has no sample before it: the states of rest
        return f"""{name}(recording_id, channel, k, y, {", ".join(states)}) AS (
  SELECT recording_id, channel, 0, 0.0::DOUBLE, {first} FROM {seq}
  UNION ALL
  SELECT recording_id, channel, k, y, {named} FROM (
    SELECT q.recording_id, q.channel, {name}.k + 1 AS k, {", ".join(lines)}, y{len(sections) - 1} AS y FROM {name} JOIN {seq} q ON q.recording_id = {name}.recording_id AND q.channel = {name}.channel AND {name}.k < len(q.v)
  )
)"""

    return f"""WITH RECURSIVE {LINE_SAMPLES}, lists AS (
  SELECT recording_id, channel, list(v ORDER BY t) AS v FROM (SELECT recording_id, t, unnest(x) AS v, unnest([1, 2, 3, 4]) AS channel FROM samples) GROUP BY ALL
), sized AS (SELECT *, len(v) AS n, least({pad}, len(v) - 1) AS pad FROM lists), padded AS (
  SELECT recording_id, channel, list_concat(list_transform(range(1, pad + 1), lambda k: 2 * v[1] - v[pad + 2 - k]), v, list_transform(range(1, pad + 1), lambda k: 2 * v[n] - v[n - k])) AS v FROM sized
), {step("forth", "padded")}, turned AS (
  SELECT recording_id, channel, list(y ORDER BY k DESC) AS v FROM forth WHERE k > 0 GROUP BY ALL
), {step("back", "turned")}, done AS (
  SELECT b.recording_id, b.channel, s.n + s.pad - (b.k - s.pad) + 1 - s.pad AS t, b.y FROM back b JOIN sized s ON s.recording_id = b.recording_id AND s.channel = b.channel WHERE b.k > s.pad AND b.k <= s.pad + s.n
)
SELECT recording_id, t, {", ".join(f"round(max(y) FILTER (channel = {c}), 5) + 0.0 AS x{c}" for c in range(1, CHANNELS + 1))} FROM done GROUP BY recording_id, t"""


def _rate_sql(up: int, down: int) -> str:
    taps = filters.resampling_taps(up, down)
    half = len(taps) // 2
    return f"""WITH {LINE_SAMPLES}, h AS (SELECT {taps.tolist()}::DOUBLE[] AS h), n AS (SELECT recording_id, max(t) AS n FROM samples GROUP BY recording_id),
m AS (SELECT recording_id, unnest(range((n * {up} + {down - 1}) // {down})) AS m FROM n),
met AS (SELECT recording_id, m, unnest(range((m * {down} - {half} + {up * 10**6}) // {up} - {10**6}, (m * {down} + {half}) // {up} + 1)) AS k FROM m)
SELECT met.recording_id, m + 1 AS t, {", ".join(f"round(sum(x[{c}] * h[m * {down} - k * {up} + {half} + 1]), 8) + 0.0 AS x{c}" for c in range(1, CHANNELS + 1))}
FROM met JOIN samples s ON s.recording_id = met.recording_id AND s.t = k + 1 CROSS JOIN h WHERE m * {down} - k * {up} BETWEEN {-half} AND {half} GROUP BY met.recording_id, m"""


def _columns(rows, digits: int = 8):
    return rows.select("recording_id", "t", *[(F.round(F.col("x")[i], digits) + 0.0).alias(f"x{i + 1}") for i in range(CHANNELS)])


@query(_filter_sql())
def band_pass(spark, sf_dir):
    # eight sections, each way: engines agree to some 1e-13
    return _columns(scans.band_pass(line_samples(spark, sf_dir), *_BAND, width=BLOCK), 5)


@query(_rate_sql(3, 4))
def resample_polyphase(spark, sf_dir):
    return _columns(scans.resample(line_samples(spark, sf_dir), 3, 4, width=BLOCK))


@query(f"""WITH {EVENT_SAMPLES}, n AS (SELECT recording_id, ceil(max(t) * 2 / 3.0)::BIGINT AS n FROM samples GROUP BY recording_id),
moved AS (SELECT recording_id, t AS place, greatest(1, least(round_even(t * 2 / 3.0::DOUBLE, 0)::BIGINT, n)) AS t, stim FROM samples JOIN n USING (recording_id) WHERE stim <> 0)
SELECT recording_id, t, arg_max(stim, place) AS stim, count(*) - 1 AS clashes FROM moved GROUP BY recording_id, t""")
def resample_polyphase_stim(spark, sf_dir):
    return scans.resampled_stim(event_samples(spark, sf_dir), 2, 3)


def _scaled_sql(rounds: int) -> str:
    """Rounds of channel factors, each from the sample factors that the last ones give."""
    mean = lambda c: "(" + " + ".join(f"x[{i}] * {c}.c{i}" for i in range(1, CHANNELS + 1)) + f") / {CHANNELS}"
    parts = [f"c1 AS (SELECT recording_id, {', '.join(f'1 / avg(x[{i}]) AS c{i}' for i in range(1, CHANNELS + 1))} FROM samples GROUP BY recording_id)"]
    for n in range(2, rounds + 1):
        parts.append(f"c{n} AS (SELECT recording_id, {', '.join(f'1 / avg(x[{i}] / ({mean(f"c{n - 1}")})) AS c{i}' for i in range(1, CHANNELS + 1))} FROM samples JOIN c{n - 1} USING (recording_id) GROUP BY recording_id)")
    last = f"c{rounds}"
    return f"WITH {LINE_SAMPLES}, {', '.join(parts)} SELECT recording_id, t, {', '.join(f'round(x[{i}] * {last}.c{i} / ({mean(last)}), 8) + 0.0 AS x{i}' for i in range(1, CHANNELS + 1))} FROM samples JOIN {last} USING (recording_id)"


@query(_scaled_sql(5))
def mean_normalise(spark, sf_dir):
    return _columns(scans.scaled_both_ways(line_samples(spark, sf_dir), CHANNELS, 5, 0.0))
