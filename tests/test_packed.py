import os
import random
import tracemalloc

import pytest
import zstandard

from plumbline.sources import eventlog, packed


def pack(path, texts, **how):
    """One frame per text."""
    with open(path, "wb") as out:
        for text in texts:
            out.write(zstandard.ZstdCompressor(**how).compress(text))


def listed(spark, *paths):
    rows = [(f"file:{p}", os.path.getsize(p)) for p in paths]
    return spark.createDataFrame(rows, "path string, length bigint")


def lines_of(spark, paths, **how):
    found = {}
    for r in packed.packed_lines(listed(spark, *paths), **how).collect():
        found.setdefault(os.path.basename(r.path), []).append(r.value)
    return {name: sorted(values) for name, values in found.items()}


def test_every_line_comes_once_wherever_frames_end(spark, tmp_path):
    """Frames cut in mid-line, in mid-character, after a line break, empty, and without any break."""
    rng = random.Random(4)
    expected, paths = {}, []
    for number in range(12):
        lines = [f"{number} {i} " + "é" * rng.choice([0, 1, 5, 400]) for i in range(rng.choice([1, 3, 40]))]
        raw = "\n".join(lines).encode() + rng.choice([b"", b"\n"])
        cuts = sorted(rng.choices(range(len(raw) + 1), k=rng.choice([0, 1, 7, 25])))
        path = tmp_path / f"log{number}.zstd.compact"
        pack(path, [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])], write_checksum=number % 2 == 0)
        paths.append(path)
        expected[path.name] = sorted(lines)
    for bytes_per_task in (150, 1 << 20):
        assert lines_of(spark, paths, bytes_per_task=bytes_per_task) == expected


def test_frames_are_found_by_their_headers(tmp_path):
    path = tmp_path / "a"
    pack(path, [b"x" * 300_000, os.urandom(200_000), b""], write_checksum=True)
    with open(path, "ab") as out:
        out.write((0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345")
    size = os.path.getsize(path)
    found = list(packed.stretches(f"file:{path}", size, 1))
    assert len(found) == 4 and [f[2] for f in found] == [0, *(f[3] for f in found[:-1])] and found[-1][3] == size
    assert not any(cut for *_, cut in found)
    assert [f[4] for f in packed.stretches(f"file:{path}", size - 2, 1)] == [False, False, False, True]


def test_memory_does_not_follow_the_size_of_a_log(tmp_path):
    """400 MB of text in one frame, 30 MB packed, a few MB at a time."""
    path = tmp_path / "big.zstd.compact"
    line = os.urandom(75).hex().encode()
    n = 0
    with open(path, "wb") as out, zstandard.ZstdCompressor(level=1).stream_writer(out) as packer:
        for block in range(400):
            salt = os.urandom(75 * 1000).hex().encode()
            text = b"".join(line + salt[i * 150 : i * 150 + 150] + b" " * 700 + b"\n" for i in range(1000))
            packer.write(text)
            n += 1000
    size = os.path.getsize(path)
    assert size > 30e6
    tracemalloc.start()
    got = sum(1 for stretch in packed.stretches(f"file:{path}", size, 8 << 20) for _ in packed.owned_lines(f"file:{path}", stretch[2], stretch[3], size))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and peak < 16e6


def test_cut_off_and_foreign_files(spark, tmp_path):
    whole, cut, foreign, empty = (tmp_path / f"{x}.zstd.compact" for x in "abcd")
    text = "\n".join(f"line {i} {random.random()}" for i in range(20_000)).encode()
    pack(whole, [text])
    cut.write_bytes(whole.read_bytes()[: os.path.getsize(whole) // 2])
    foreign.write_bytes(b"plain text, not packed")
    empty.write_bytes(b"")
    with pytest.raises(Exception, match="b.zstd.compact is cut off"):
        packed.packed_lines(listed(spark, cut)).count()
    found = lines_of(spark, [whole, cut, empty], tolerate_cut_off=True)
    assert len(found["a.zstd.compact"]) == 20_000 and 1000 < len(found["b.zstd.compact"]) < 20_000
    with pytest.raises(Exception, match="no zstd frame"):
        packed.packed_lines(listed(spark, foreign)).count()


def test_compacted_logs_are_split_at_frames(spark, tmp_path):
    log = tmp_path / "eventlog_v2_app"
    log.mkdir()
    pack(log / "events_1_app.zstd.compact", [f'{{"Event":"E{i}"}}\n'.encode() * 50 for i in range(30)])
    lines = eventlog.read_log_lines(spark, str(tmp_path), bytes_per_task=40)
    assert lines.count() == 1500
    assert {r.run_key.rsplit("/", 1)[1] for r in lines.select("run_key").distinct().collect()} == {"eventlog_v2_app"}
    spread = lines.where("value like '%Event%'").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(1 for n in spread if n) > 4
