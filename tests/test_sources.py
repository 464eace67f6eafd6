"""Small files and dead letters."""

import os

from glossaline.sources import files, small_files
from glossaline.streaming import dead_letters


def test_packing_is_even_and_bounded():
    sizes = [(f"f{i:05}", (i * 7919) % 5000 + (10**6 if i == 3 else 0)) for i in range(10_000)]
    bins = small_files.packed(sizes, 16)
    assert len(bins) == 16 and sorted(p for b in bins for p in b) == sorted(p for p, _ in sizes)
    size = dict(sizes)
    weights = [sum(size[p] + small_files.OPENING for p in b) for b in bins]
    assert max(weights) - min(weights) < 10**6
    assert small_files.packed([], 4) == [[]] and small_files.packed([("a", 1)], 4) == [["a"]]


def test_many_small_files_in_few_tasks(spark, tmp_path):
    for i in range(600):
        folder = tmp_path / f"job_{i}"
        folder.mkdir()
        (folder / "job.json").write_bytes(b"{broken" if i % 100 == 7 else b"\xff\xfe" if i == 8 else f'{{"job_id": "job_{i}", "total_segments": {i}}}\n'.encode())
        (folder / "log.txt").write_text("other")
    df = files.job_files(spark, str(tmp_path), partitions=12)
    assert df.rdd.getNumPartitions() == 12
    rows = df.collect()
    assert len(rows) == 600 and sum(r["is_corrupt"] for r in rows) == 7
    assert {(r["job_id"], r["total_segments"]) for r in files.read_jobs(spark, str(tmp_path)).collect()} == {(f"job_{i}", i) for i in range(600) if i % 100 != 7 and i != 8}


def test_conditions_on_the_path_leave_files_unread(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text(name)
    os.chmod(tmp_path / "c.txt", 0)
    read = small_files.read_files(spark, str(tmp_path))
    got = read.filter(read.path.endswith("/a.txt")).selectExpr("cast(content as string) as text", "length").collect()
    assert [tuple(r) for r in got] == [("a", 1)]
    one = read.filter(read.path.endswith("/b.txt"))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert small_files.read_files(spark, str(tmp_path / "missing")).count() == 0


def test_files_are_written_one_per_row(spark, tmp_path):
    rows = [("x/one.txt", "a\r\nb\rc"), ("x/y/two.txt", None), ("three.txt", "é")]
    assert small_files.write_files(spark.createDataFrame(rows, "path string, text string"), str(tmp_path)) == 3
    assert (tmp_path / "x/one.txt").read_bytes() == b"a\nb\nc" and (tmp_path / "x/y/two.txt").read_bytes() == b"" and (tmp_path / "three.txt").read_text() == "é"


def test_dead_letters_of_several_files(spark, tmp_path):
    log, schema = tmp_path / "log", "job_id string, n int"
    log.mkdir()
    (log / "one.jsonl").write_text('{"job_id": "a", "n": 1}\n\n{"job_id": "b"\n')
    (log / "two.jsonl").write_text('{"job_id": "c", "n": "many"}\n{"n": 5}\nplain text\n')
    good, bad, state = (str(tmp_path / x) for x in ("good", "bad", "state"))

    def run():
        dead_letters.split(dead_letters.read_lines(spark, str(log), schema, max_files=1), good, bad, state).awaitTermination()

    run()
    assert {tuple(r) for r in dead_letters.read_good(spark, good, schema).collect()} == {("a", 1), (None, 5)}
    assert {tuple(r) for r in dead_letters.read_bad(spark, bad).collect()} == {("one.jsonl", '{"job_id": "b"'), ("two.jsonl", '{"job_id": "c", "n": "many"}'), ("two.jsonl", "plain text")}
    (log / "three.jsonl").write_text('{"job_id": "d", "n": 2}\n{{\n')
    run()
    assert dead_letters.read_good(spark, good, schema).count() == 3 and dead_letters.read_bad(spark, bad).count() == 4


def test_the_driver_gets_partitions_not_files(spark, tmp_path, monkeypatch):
    import pickle

    monkeypatch.setattr(small_files, "FEW", 50)  # files that the driver packs by itself
    for i in range(400):
        folder = tmp_path / f"a{i % 3}" / f"job_{i}"
        folder.mkdir(parents=True)
        (folder / "job.json").write_text("x" * (1 + i % 7) if i != 5 else "y" * 300_000)
        (folder / "job.json.bak").write_text("no")
    (tmp_path / "empty").mkdir()
    found = small_files.list_files(spark, f"file://{tmp_path}", "job.json")
    want = {f"{tmp_path}/a{i % 3}/job_{i}/job.json": 1 + i % 7 if i != 5 else 300_000 for i in range(400)}
    assert {r.path: r.size for r in found.collect()} == want and found.count() == 400
    folder = small_files.pack_files(found, 8)
    reader = small_files.SmallFilesReader({"path": str(tmp_path), "packed": folder})
    parts = reader.partitions()
    # What the driver holds and sends does not grow with the files.
    assert len(parts) == 8 and all(len(pickle.dumps(p.__dict__)) < 1000 for p in parts)
    held = [list(reader.paths(p.folder)) for p in parts]
    assert sorted(x for h in held for x in h) == sorted(want)
    weights = [sum(want[x] + small_files.OPENING for x in h) for h in held]
    assert max(weights) - min(weights) <= 2 * (300_000 + small_files.OPENING)
    df = small_files.read_files(spark, str(tmp_path), "job.json", 8)
    assert df.rdd.getNumPartitions() == 8 and {(r.path, r.length, len(r.content)) for r in df.collect()} == {(p, n, n) for p, n in want.items()}
    # Files that a condition wants are spread over the partitions as well.
    some = df.filter(df.path.startswith(f"{tmp_path}/a1/"))
    assert some.count() == sum("/a1/" in p for p in want) and some.rdd.getNumPartitions() >= 6
