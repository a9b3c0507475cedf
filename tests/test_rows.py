"""Micro-batches bounded by rows."""

from logwarden.session import scratch_path
from logwarden.sources.rows import RowReader, stream_rows
from logwarden.streaming.files import read_all


def test_offsets(tmp_path):
    (tmp_path / "a").write_bytes(b"1\n2\n3\n4\n5\n")
    (tmp_path / "b").write_bytes(b"6\r\n7\n\nunfinished")
    (tmp_path / "_c").write_bytes(b"no\n")
    reader, start, got, sizes = RowReader(str(tmp_path), 3), None, [], []
    start = reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        rows = [r[0] for p in reader.partitions(start, end) for r in reader.read(p)]
        got, start = got + rows, end
        sizes.append(len(rows))
    assert got == ["1", "2", "3", "4", "5", "6", "7", ""] and sizes == [3, 3, 2]
    # A new reader goes on from the end of the batch that is planned first.
    with open(tmp_path / "b", "ab") as f:
        f.write(b" now\n")
    again = RowReader(str(tmp_path), 3)
    again.partitions({"file": "a", "byte": 4, "row": 2}, start)
    end = again.latestOffset()
    assert [r[0] for p in again.partitions(start, end) for r in again.read(p)] == ["unfinished now"]


def test_stream_is_bounded_and_whole(spark, tmp_path):
    folder, base = tmp_path / "in", scratch_path(spark, "rows")
    folder.mkdir()
    (folder / "1").write_text("".join(f"line {k}\n" for k in range(700)))
    (folder / "2").write_text("".join(f"line {k}\n" for k in range(700, 1_000)))
    sizes = {}

    def handle(batch, batch_id):
        sizes[batch_id] = batch.count()
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    for _ in range(2):  # the second run is a restart that finds nothing new
        writer = stream_rows(spark, str(folder), 150).writeStream.foreachBatch(handle)
        query = writer.option("checkpointLocation", f"{base}/cp").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert max(sizes.values()) <= 150 and sum(sizes.values()) == 1_000
    got = [r["value"] for r in read_all(spark, f"{base}/out", "value string").collect()]
    assert sorted(got) == sorted(f"line {k}" for k in range(1_000))
