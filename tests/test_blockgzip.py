"""Block-compressed files: splits, index, region reads and the writer."""

import bz2
import gzip
import lzma
import random
import struct
import zlib

import pytest

from genoloom.sources import blockgzip as bg
from genoloom.sources import genotypes, sinks, text

HEADER = '##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n'


def records(n=6000, seed=1):
    rng = random.Random(seed)
    out = []
    for name in ("Chr01", "Chr02", "scaffold_9"):
        pos = 0
        for _ in range(n // 3):
            pos += rng.randint(1, 900)
            ref = "A" * rng.choice([1, 1, 1, 30])
            out.append((name, pos, ref, f"{name}\t{pos}\ts{len(out)}\t{ref}\tG\t.\tPASS\t.\tGT\t{rng.choice(['0/0', '0/1', '1|1', './.'])}\t0/1"))
    return out


def foreign(path, body, size=900):
    """A file as other tools write it: blocks cut anywhere, also within lines, and some empty."""
    with open(path, "wb") as f:
        for k, a in enumerate(range(0, len(body), size)):
            f.write(bg.block(body[a : a + size]))
            if k % 7 == 3:
                f.write(bg.block(b""))
        f.write(bg.END)


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    path = tmp_path_factory.mktemp("vcf") / "x.vcf.gz"
    rows = records()
    foreign(path, (HEADER + "\n".join(r[3] for r in rows) + "\n").encode())
    return str(path), rows


@pytest.mark.parametrize("split", [300, 5000, 1 << 20])
def test_splits_give_every_line_once(spark, vcf, split):
    path, rows = vcf
    df = bg.packed_lines(spark, path, bg.compression(path), split)
    if split < 1 << 20:
        assert df.rdd.getNumPartitions() > 5
    got = [r.value for r in df.orderBy("line").collect()]
    assert got == HEADER.splitlines() + [r[3] for r in rows]


def test_lines_longer_than_blocks_and_no_last_line_end(spark, tmp_path):
    body = "\n".join(["a" * 200_000, "", "b", "c" * 70_000, "é"])
    foreign(tmp_path / "l.gz", body.encode(), 5000)
    for split in (50, 400, 1 << 20):
        got = [r.value for r in bg.packed_lines(spark, str(tmp_path / "l.gz"), "blocks", split).orderBy("line").collect()]
        assert got == body.split("\n")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out") / "w.vcf.gz")
    rows = records(40_000, 2)
    df = spark.createDataFrame([(v, n, p - 1, p + len(r) - 2, {"Chr01": 0, "Chr02": 1, "scaffold_9": 2}[n]) for n, p, r, v in rows], "value string, name string, first long, last long, o int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    bg.write_blocks_text(df.orderBy("o", "first"), path, HEADER)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, rows


def test_parts_are_one_plain_file(spark, written, tmp_path):
    path, rows = written
    files = bg.listed(path)
    assert len(files) > 4
    whole = b"".join(open(p, "rb").read() for p, _ in files)
    assert gzip.decompress(whole).decode() == HEADER + "".join(r[3] + "\n" for r in rows)
    one = bg.joined(spark, path, str(tmp_path / "one.vcf.gz"))
    assert open(one, "rb").read() == whole and open(one + ".tbi", "rb").read() == open(f"{path}/index.tbi", "rb").read()
    at = 0
    while at < len(whole):  # every block holds its own length, text length and check value
        size = bg.block_size(whole[at : at + 64])
        data = zlib.decompress(whole[at + 18 : at + size - 8], -15)
        assert struct.unpack("<II", whole[at + size - 8 : at + size]) == (zlib.crc32(data), len(data)) and len(data) <= bg.BLOCK_TEXT
        at += size


@pytest.mark.parametrize("joined", [False, True])
def test_region_opens_few_blocks(spark, written, tmp_path, joined):
    path, rows = written
    if joined:
        path = bg.joined(spark, path, str(tmp_path / "one.vcf.gz"))
    index = bg.index_of(path)
    assert index.names == ["Chr01", "Chr02", "scaffold_9"]
    total = bg.packed_lines(spark, path, "blocks").select("block").distinct().count()
    for chrom, start, end in (("Chr02", 100_000, 160_000), ("Chr01", 1, 1), ("scaffold_9", 5_000_000, None), ("Chr01", None, None), ("Chr02", 90_000_000, 100_000_000)):
        got = bg.region_lines(spark, path, index, [chrom], start, end)
        want = [v for n, p, r, v in rows if n == chrom and p + len(r) - 1 >= (start or 1) and p <= (end or 1 << 30)]
        lines = [r.value for r in got.orderBy("line").collect()]
        assert set(want) <= set(lines) and len(lines) == len(set(lines)) and all(x.startswith(chrom) for x in lines)
        if end and end < 1_000_000:
            assert got.select("block").distinct().count() <= 4 < total
        g = genotypes.read_vcf(spark, path, chrom.lower() if "scaffold" not in chrom else chrom, start, end)
        assert {r.id for r in g.variants.collect()} == {v.split("\t")[2] for n, p, _, v in rows if n == chrom and (start or 1) <= p <= (end or 1 << 30)}
    with pytest.raises(ValueError, match="Chr02"):
        genotypes.read_vcf(spark, path, "7")


def test_large_span_is_many_tasks(spark, written):
    path, rows = written
    df = bg.region_lines(spark, path, bg.index_of(path), ["Chr02"], split=20_000)
    assert df.rdd.getNumPartitions() > 3
    assert [r.value for r in df.orderBy("line").collect()] == [r[3] for r in rows if r[0] == "Chr02"]


def test_index_keeps_the_bins_law(written):
    path, rows = written
    index, data = bg.index_of(path), b"".join(open(p, "rb").read() for p, _ in bg.listed(path))
    place, at, held = {}, 0, {}
    for offset, body in bg.blocks(bg.Bytes(bg.listed(path)), 0):
        held[offset] = body
    text_at = 0
    for offset, body in held.items():
        place[text_at] = offset
        text_at += len(body)
    assert len(data) == sum(n for _, n in bg.listed(path))
    starts = sorted(place)
    import bisect

    at = len(HEADER)
    for name, pos, ref, line in rows:
        k = starts[bisect.bisect_right(starts, at) - 1]
        voff = place[k] << 16 | (at - k)
        i = index.names.index(name)
        first, last = pos - 1, pos + len(ref) - 2
        assert any(b <= voff < e for b, e in index.bins[i][bg.bin_of(first, last)])
        assert index.windows[i][first >> 14] <= voff
        at += len(line) + 1


def test_other_compression_is_told_by_its_bytes(spark, tmp_path):
    body = "".join(f"line {i}\r\n" for i in range(5000)) + "end"
    want = body.replace("\r", "").split("\n")
    packed = {"a.xz": lzma.compress(body.encode()), "b.txt": gzip.compress(body.encode()) , "c.txt": bz2.compress(body.encode()), "d.txt": gzip.compress(body[:100].encode()) + gzip.compress(body[100:].encode()), "e.gz": gzip.compress(body.encode()), "f.xz": lzma.compress(body[:100].encode()) + lzma.compress(body[100:].encode())}
    for name, data in packed.items():
        (tmp_path / name).write_bytes(data)
        assert [r.value for r in text.lines(spark, str(tmp_path / name)).orderBy("line").collect()] == want, name
        assert text.head(spark, str(tmp_path / name), 2) == ["line 0", "line 1"]


def test_hapmap_to_indexed_vcf(spark, tmp_path):
    fixed = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanelLSID\tQCcode\tx\ty"
    rows = [f"m{c}_{p}\tA/G\t{c}\t{p}\t+\t.\t.\t.\t.\t.\t.\tAA\tAG" for p in range(3000, 0, -7) for c in ("2", "1")]
    (tmp_path / "h.hmp.txt").write_text("\n".join([fixed, *rows]) + "\n")
    out = str(tmp_path / "h.vcf.gz")
    count = sinks.hapmap_to_vcf(spark, str(tmp_path / "h.hmp.txt"), out, compression="bgzip")
    assert count["written"] == len(rows)
    g = genotypes.read_vcf(spark, out, "1", 100, 200)
    assert sorted(r.pos for r in g.variants.collect()) == [p for p in range(1, 3001) if (3000 - p) % 7 == 0 and 100 <= p <= 200]
    assert {(r["sample"], r.dos) for r in g.calls.collect()} == {("x", 0.0), ("y", 1.0)}
    assert genotypes.read_vcf(spark, out).variants.count() == len(rows)
