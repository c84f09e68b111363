"""Streams of cues in shuffled micro-batches give what the batch operators give."""

import json
import os
import random

import pytest

from cueloom.operators import qc, timing
from cueloom.streaming import ordered

KIND = "file_id string, cue_no int, start_ms bigint, end_ms bigint, text string, ts timestamp, min_duration_seconds double, max_duration_seconds double, min_interval_seconds double, reading_speed_max_cps int"
NAMES = [c.split(" ")[0] for c in KIND.split(", ")]
BASE_S = 1_700_000_000


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Cues of six files, each up to four seconds late, in eight micro-batches; the last one holds a cue an hour later."""
    import datetime

    rng = random.Random(8)
    at = lambda ms: datetime.datetime.fromtimestamp(BASE_S + ms / 1000, datetime.UTC)
    rows = []
    for f in range(6):
        now = 0
        for k in range(1, 41):
            start, end = now, now + rng.choice((300, 900, 2500))
            now = end + rng.choice((-200, 0, 80, 120, 240, 400, 2000))
            timed = rng.random() > 0.05
            rows.append((f"f{f}", k, start if timed else None, end if timed and rng.random() > 0.05 else None, "x" * rng.randint(1, 60), at(1000 * k), 0.8, 5.0, 0.08, 17))
    shuffled = sorted(rows, key=lambda r: r[1] * 1000 + rng.uniform(0, 4000))
    folder = tmp_path_factory.mktemp("stream")
    size = -(-len(shuffled) // 7)
    parts = [shuffled[k : k + size] for k in range(0, len(shuffled), size)] + [[("later", 1, 0, 1000, "x", at(3_700_000), 0.8, 5.0, 0.08, 17)]]
    for k, part in enumerate(parts):
        path = folder / f"part-{k}.json"
        path.write_text("".join(json.dumps(dict(zip(NAMES, r, strict=True)), default=str) + "\n" for r in part))
        os.utime(path, (BASE_S + k, BASE_S + k))
    return str(folder), spark.createDataFrame(rows, KIND)


def _streamed(spark, folder, make, name, tmp_path):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(folder)
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return sorted(tuple(r) for r in spark.table(name).collect() if r.file_id != "later")


def test_gaps_of_shuffled_micro_batches(spark, batches, tmp_path):
    folder, table = batches
    expected = sorted(map(tuple, qc.gap_defects(table).collect()))
    assert expected and _streamed(spark, folder, lambda s: ordered.gap_defects(s, late="6 seconds"), "gaps", tmp_path) == expected


def test_repair_of_shuffled_micro_batches(spark, batches, tmp_path):
    folder, table = batches
    expected = sorted(map(tuple, timing.repair_windows(table).select("file_id", "cue_no", "start_ms", "end_ms").collect()))
    assert len(expected) > 200 and _streamed(spark, folder, lambda s: ordered.repair_windows(s, late="6 seconds"), "repaired", tmp_path) == expected
