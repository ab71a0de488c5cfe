"""Running totals extended by appends against a full run, and what an append reads and writes."""

import random

import pytest

from crawlgrain.operators.ledger import running_sums
from crawlgrain.operators.running_log import RunningLog

DDL = "key string, id long, v long, w decimal(20,4), note string"


def rows(ids, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{i % 3}", i, rng.randrange(100), rng.randrange(1000), f"n{i}") for i in ids]


def frame(spark, data):
    import decimal
    return spark.createDataFrame([(k, i, v, decimal.Decimal(w) / 10, n) for k, i, v, w, n in data], DDL).repartition(3)


def totals(df):
    return sorted((r.id, r.key, r.note, r.running_v, r.running_w) for r in df.collect())


def full(spark, data, bits):
    return totals(running_sums(frame(spark, data), ["key"], "id", ["v", "w"], bits=bits))


def log(spark, folder, bits=3):
    return RunningLog(spark, str(folder / "log"), ["key"], "id", ["v", "w"], bits)


@pytest.mark.parametrize("bits", [2, 5])
def test_appends_equal_a_full_run(spark, tmp_path, bits):
    held, data = log(spark, tmp_path, bits), []
    for part in (range(0, 37), range(37, 40), range(40, 90), range(90, 91)):
        new = rows(part, part.start)
        held.append(frame(spark, new))
        data += new
        assert totals(held.totals()) == full(spark, data, bits)


def test_an_append_writes_only_open_blocks(spark, tmp_path):
    held = log(spark, tmp_path)
    held.append(frame(spark, rows(range(0, 100))))
    for block in range(12):                                     # whoever read a closed block would fail
        for f in (tmp_path / "log/rows/append=0" / f"block={block}").glob("*.parquet"):
            f.write_bytes(f.read_bytes()[:8])
    held.append(frame(spark, rows(range(100, 106), 2)))
    made = {p.name for p in (tmp_path / "log/rows/append=1").iterdir() if p.is_dir()}
    assert made == {"block=12", "block=13"}


def test_late_rows_open_their_block_again(spark, tmp_path):
    held = log(spark, tmp_path)
    first, late = rows([i for i in range(60) if i not in (5, 17)]), rows([5, 17, 60], 3)
    held.append(frame(spark, first))
    held.append(frame(spark, late))
    assert totals(held.totals()) == full(spark, first + late, 3)


def test_appending_again_changes_nothing(spark, tmp_path):
    held, data = log(spark, tmp_path), rows(range(30))
    held.append(frame(spark, data))
    for _ in range(3):
        held.append(frame(spark, data[20:]))
    assert totals(held.totals()) == full(spark, data, 3)
    assert len(list((tmp_path / "log/rows").glob("append=*/block=3"))) <= 2      # replaced blocks go


def test_an_unfinished_append_is_not_seen(spark, tmp_path):
    held, data = log(spark, tmp_path), rows(range(20))
    held.append(frame(spark, data))
    held.append(frame(spark, rows(range(20, 30), 2)))
    (tmp_path / "log/sums/append=1/_SUCCESS").unlink()
    assert totals(held.totals()) == full(spark, data, 3)
    held.append(frame(spark, rows(range(20, 30), 2)))
    assert totals(held.totals()) == full(spark, data + rows(range(20, 30), 2), 3)


def test_nothing_appended(spark, tmp_path):
    held = log(spark, tmp_path)
    with pytest.raises(ValueError):
        held.totals()
    held.append(frame(spark, []))
    with pytest.raises(ValueError):
        held.totals()
