"""Byte ranges: what is read, and the same rows wherever files are cut."""

import io
import json
import random

import pytest
from pyspark.sql import types as T

from logwarden.sources import files, jsonarrays, ranges
from logwarden.streaming import streams

REC = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    bytes = 0

    def read(self, n=-1):
        part = super().read(n)
        self.bytes += len(part)
        return part


def test_ranges_give_every_line_once():
    rng = random.Random(4)
    text = b"".join(bytes(rng.choice(b"ab \n") for _ in range(rng.choice([0, 3, 900]))) + b"\n" for _ in range(60)) + b"open end"
    want = text.split(b"\n")[:-1]
    for _ in range(40):
        cuts = sorted(rng.sample(range(1, len(text)), rng.choice([1, 5, 200])))
        got = [x for a, b in zip([0, *cuts], [*cuts, len(text)]) for x in ranges.lines_between(io.BytesIO(text), a, b)]
        assert [line for _, line in got] == want and [end for end, _ in got] == [i + 1 for i, c in enumerate(text) if c == 10]


def test_only_the_added_bytes_are_read():
    old, new = b"x" * 99 + b"\n", b"one\ntwo\n"
    file = Counted(old * 100_000 + new)
    start = len(old) * 100_000
    assert [line for _, line in ranges.lines_between(file, start, start + len(new))] == [b"one", b"two"]
    assert file.bytes <= len(new) + 256
    # A range inside a long line reads itself only, and the one with its end looks back for its beginning.
    file = Counted(b"y" * 1_000_000 + b"\n")
    assert list(ranges.lines_between(file, 1000, 2000)) == [] and file.bytes == 1000
    assert [len(x) for _, x in ranges.lines_between(file, 999_000, 1_000_001)] == [1_000_000]


def test_tail_does_not_open_what_it_knows(spark, tmp_path):
    """The known bytes are replaced by others: a poll that read them would show it."""
    log = tmp_path / "a.log"
    log.write_text("first line\n" * 1000)
    lines, at = files.tail_log_dir(spark, str(tmp_path), None)
    assert lines.count() == 1000
    log.write_text("OTHER LINE\n" * 1000 + "added\nhalf")
    lines, at = files.tail_log_dir(spark, str(tmp_path), at)
    assert [r.message for r in lines.collect()] == ["added"] and at.first().position == 11006


def test_tail_as_a_stream(spark, tmp_path):
    logs, out, ck = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")
    logs.mkdir()
    seen = []

    def poll():
        streams.run_available(files.tail_stream(spark, str(logs), "*.log"), out, ck)
        rows = sorted(r.message for r in spark.read.parquet(out).collect())
        fresh = list(rows)
        for m in seen:
            fresh.remove(m)
        seen[:] = rows
        return fresh

    (logs / "a.log").write_text("one\ntwo\nthr")
    (logs / "b.txt").write_text("not read\n")
    assert poll() == ["one", "two"]
    (logs / "a.log").write_text("one\ntwo\nthree\n\nfour\n")
    (logs / "c.log").write_text("x\n")
    assert poll() == ["four", "three", "x"]
    (logs / "a.log").write_text("new\n")
    assert poll() == ["new"] and poll() == []


def test_tail_source_in_batch(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(500)))
    spark.dataSource.register(ranges.LogTail)
    read = lambda **o: spark.read.format("log_tail").options(path=str(tmp_path), **o).load()
    assert sorted(r.message for r in read(rangeBytes="100").collect()) == sorted(f"line {i}" for i in range(500))
    assert read(positions=json.dumps({f"file:{tmp_path}/a.log": 4381})).count() == 1


def test_heads_read_little(spark, tmp_path, monkeypatch):
    import gzip

    (tmp_path / "big.dat").write_text("a,b\n" * 100_000)
    (tmp_path / "z.dat.gz").write_bytes(gzip.compress(b'{"a":1}\n' * 100_000))
    (tmp_path / "empty").write_text("")  # has no first lines
    got = {r.path.rsplit("/", 1)[1]: len(r.head) for r in ranges.heads(spark, str(tmp_path), 1000).collect()}
    assert got == {"big.dat": 1000, "z.dat.gz": got["z.dat.gz"]} and 0 < got["z.dat.gz"] <= 1000
    kinds = files.classify_files(files.numbered_heads(spark, str(tmp_path)))
    assert {r.source_file.rsplit("/", 1)[1]: r.format for r in kinds.collect()} == {"big.dat": "csv", "z.dat.gz": "json"}


def nasty(rng, depth=0):
    text = lambda: "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", "é", "x", "\n", "\\\\", '\\"']) for _ in range(rng.randint(0, 8)))
    if depth > 2 or rng.random() < 0.5:
        return rng.choice([text(), 1.5, None, True])
    return rng.choice([lambda: [nasty(rng, depth + 1) for _ in range(3)], lambda: {text(): nasty(rng, depth + 1) for _ in range(3)}])()


def test_blocks_find_the_elements_of_an_array():
    """Whatever the borders: effects compose to the true beginnings, and every element comes from one block."""
    rng = random.Random(6)
    for _ in range(60):
        values = [{"k": nasty(rng), "n": i} for i in range(rng.randint(0, 12))]
        data = json.dumps(values, ensure_ascii=False, indent=rng.choice([None, 2])).encode()
        cuts = sorted(rng.sample(range(1, len(data)), min(len(data) - 1, rng.choice([0, 1, 7, 60]))))
        state, depth, got = jsonarrays.OUTSIDE, 0, []
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            part = data[a:b]
            steps, _, end = jsonarrays.depth_steps(jsonarrays.np.frombuffer(part, dtype="uint8"), state)
            for x, y in jsonarrays.record_spans(part, state, depth):
                rest = b"" if y is not None else b"".join(jsonarrays.rest_of_record(io.BytesIO(data), b, len(data), end, depth + int(steps.sum())))
                got.append((part[x:y] + rest).strip())
            e = jsonarrays.effect(part)[jsonarrays.WIDTH * state:][:4]
            state, depth = e[0], depth + e[1]
        assert (state, depth) == (jsonarrays.OUTSIDE, 0)
        assert [json.loads(x) for x in got if x] == values


@pytest.mark.parametrize("block", [16, 300, 8 << 20])
def test_one_array_in_many_blocks(spark, tmp_path, monkeypatch, block):
    """Strings with brackets, quotes and backslashes lie across the borders of blocks."""
    monkeypatch.setattr(jsonarrays.array_blocks, "__defaults__", (block,))
    rng = random.Random(block)
    values = [{"a": "".join(rng.choice('"\\[]{},x\n') for _ in range(rng.randint(0, 12))), "n": i} for i in range(60)]
    (tmp_path / "one.json").write_text(json.dumps(values, indent=1))
    (tmp_path / "two.json").write_text('[{"a":"c","n":\n13}]\n[{"a":"d","n":1000}]\n')
    (tmp_path / "none.json").write_text("[\n]")
    (tmp_path / "rest.json").write_text('[\n{"a":"x","n":1001},\n3, [{"a":"no"}], {"a":"y","n":1002}]')
    got = sorted((r.n, r.a) for r in files.read_json(spark, str(tmp_path), REC).collect())
    assert got == [(v["n"], v["a"]) for v in values] + [(1000, "d"), (1001, "x"), (1002, "y")]


def test_zipped_arrays_and_csv_layouts(spark, tmp_path):
    import gzip

    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json.gz").write_bytes(gzip.compress(b'[\n{"a":"x","n":1}\n]'))
    (tmp_path / "j" / "b.json").write_text('[\n{"a":"y","n":2}\n]')
    (tmp_path / "c d").mkdir()
    (tmp_path / "c d" / "1.csv").write_text("n,a\n3,p\n")
    (tmp_path / "c d" / "2.csv").write_text("a,n\nq,4\n")
    (tmp_path / "c d" / "3.csv").write_text("n,a\n5,r\n")
    skipped = []
    got = files.read_many(spark, {"json": [str(tmp_path / "j")], "csv": [str(tmp_path / "c d"), str(tmp_path / "gone")]}, REC, skipped)
    assert sorted((r.n, r.a) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "p"), (4, "q"), (5, "r")]
    assert [p for p, _ in skipped] == [str(tmp_path / "gone")]
    assert len(files.csv_layouts(spark, [str(tmp_path / "c d")])) == 2
