"""Keyed state of a stream: groups that interleave and return, and restarts."""

import os
import random
from collections import defaultdict

from statewise.streaming import scans as ss


def plain(rows):
    out = defaultdict(lambda: [0, 0, 0])
    last, seen = {}, {}
    for _, g, c, k in sorted(rows):
        t = out[g]
        if g in last and c < last[g]:
            t[0] += 1
        if g not in last or c != last[g]:
            seen[g] = set()
        t[1] += k in seen[g]
        seen[g].add(k)
        last[g] = c
        t[2] += 1
    return {g: tuple(t) for g, t in out.items()}


def test_groups_are_checked_across_files_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], defaultdict(int)
    for p in range(600):
        g = rng.choice("xyz") if p % 40 else "rare"
        at[g] += rng.choice([0, 0, 0, 1, 5]) - (7 if rng.random() < 0.03 else 0)
        rows.append((p, g, at[g], rng.choice("ab")))
    src = tmp_path / "in"
    src.mkdir()
    schema = "pos long, chrom string, coord long, allele string"

    def arrive(i, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (name,) = (tmp_path / f"w{i}").glob("*.parquet")
        (src / f"{i}.parquet").write_bytes(name.read_bytes())
        os.utime(src / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))

    def checked():
        stream = ss.file_stream(spark, str(src), schema, files_per_batch=1)
        out = ss.stream_group_check(stream, "chrom", "pos", "coord", ["allele"], str(tmp_path / "work"))
        return {r.chrom: (r.order_violations, r.duplicate_keys, r.rows) for r in out.collect()}

    for i, a in enumerate(range(0, 300, 100)):
        arrive(i, rows[a:a + 100])
    assert checked() == plain(rows[:300])
    for i, a in enumerate(range(300, 600, 50), 3):
        arrive(i, rows[a:a + 50])
    assert checked() == plain(rows)  # goes on from the kept state
    assert checked() == plain(rows)  # nothing new


def test_runs_meet_at_one_coordinate():
    import pandas as pd

    frame = lambda rows: pd.DataFrame(rows, columns=["g", "p", "c", "k"])
    parts = [[(1, 0, 5, "a"), (1, 1, 5, "b")], [(1, 2, 5, "a"), (1, 3, 5, "c")], [(1, 4, 5, "b"), (1, 5, 4, "a")], [(1, 6, 4, "a")]]
    state = None
    for part in parts:
        state = ss.merged_state(state, ss.run_summaries(frame(part)))
    assert state == (4, '["a"]', 1, 3, 7)
