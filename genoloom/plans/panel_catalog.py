"""Queries of panels and report tables, and DuckDB SQL for their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoloom.functions.genomes import KNOWN, LENGTHS, list_species
from genoloom.functions.regions import parse_region
from genoloom.operators import genotypes, gwas, intervals, panels, region, report, tree
from genoloom.plans import surrogates as s
from genoloom.plans.catalog import CAND, DENSITY, LAYOUT, PAIRS, PARSED, SIZES, G, _annotated, _blk, _density, _gwas, _sites, query
from genoloom.plans.surrogates import duck, table, view
from genoloom.streaming.ingest import windowed_counts

HERE = region.Region("3", 50_001, 400_000, "user-defined")
LD_HERE = region.Region("1", 7_001, 140_000, "user-defined")


@query(" UNION ALL ".join(f"SELECT '{k}' AS species, cast({len(LENGTHS[at])} AS bigint) AS chromosomes, round((cast(0 AS bigint) + {' + '.join(map(str, LENGTHS[at].values()))}) / 1e6, 1) AS size_mb" for k, (_, _, at, _) in KNOWN.items()))
def species_table(spark, d):
    return list_species(spark).select("species", "chromosomes", "size_mb")


REGION_TEXT = "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN concat('chr0', s_suppkey % 9 + 1, ':', s_suppkey, ',000-', s_suppkey, ' 500') WHEN 1 THEN concat(s_suppkey % 12 + 1, ':1e6-', s_suppkey % 3, '.5e6') WHEN 2 THEN concat('X:', s_suppkey, '-', s_suppkey * 2) ELSE 'nowhere' END AS r FROM {supplier}"


@query(f"""SELECT k, CASE WHEN k % 4 = 0 AND k * 1000 > cast(concat(k, '500') AS bigint) THEN NULL WHEN k % 4 = 0 THEN cast(k % 9 + 1 AS string) WHEN k % 4 = 1 AND k % 3 > 0 THEN cast(k % 12 + 1 AS string) WHEN k % 4 = 2 THEN 'X' END AS chr,
CASE WHEN k % 4 = 0 THEN k * 1000 WHEN k % 4 = 1 AND k % 3 > 0 THEN 1000000 WHEN k % 4 = 2 THEN k END AS start,
CASE WHEN k % 4 = 0 THEN cast(concat(k, '500') AS bigint) WHEN k % 4 = 1 AND k % 3 > 0 THEN (k % 3) * 1000000 + 500000 WHEN k % 4 = 2 THEN k * 2 END AS gend FROM ({duck(REGION_TEXT)})""")
def region_text(spark, d):
    r = view(spark, d, REGION_TEXT).select("k", parse_region(F.col("r")).alias("r"))
    return r.select("k", "r.chr", "r.start", F.col("r.end").alias("gend"))


def _layout(spark, d):
    g = _gwas(spark, d)
    return g, gwas.genome_layout(gwas.chrom_sizes(g))


SPAN = "mid AS (SELECT off + (50001 + 400000) / 2.0 AS mid, greatest(349999, 0.006 * (SELECT max(off + length) FROM layout)) AS w, (SELECT max(off + length) FROM layout) AS total FROM layout WHERE chr = '3')"


@query(f"WITH {PARSED}, {SIZES}, {LAYOUT}, {SPAN} SELECT round((mid - w / 2) / total, 8) AS x, 0.0 AS xend FROM mid UNION ALL SELECT round((mid + w / 2) / total, 8), 1.0 FROM mid")
def zoom_connector(spark, d):
    return panels.zoom_connector(_layout(spark, d)[1], HERE).select(F.round("x", 8).alias("x"), "xend")


@query(f"WITH {PARSED}, {SIZES}, {LAYOUT}, {SPAN} SELECT round(mid - w / 2, 2) AS xmin, round(mid + w / 2, 2) AS xmax FROM mid")
def manhattan_highlight(spark, d):
    return panels.highlight(_layout(spark, d)[1], HERE).select(F.round("xmin", 2).alias("xmin"), F.round("xmax", 2).alias("xmax"))


@query(f"WITH {PARSED}, {SIZES}, {LAYOUT} SELECT (SELECT round(max(off + length), 3) FROM layout WHERE idx <= 10) AS x_max, round(greatest(max(-log10(p)) FILTER (WHERE idx <= 10), 5.5) * 1.06, 6) AS y_max, count(*) FILTER (WHERE idx > 10) AS n_off, count(*) FILTER (WHERE idx <= 10 AND pos > length) AS n_beyond FROM gwas JOIN layout USING (chr)")
def manhattan_frame(spark, d):
    g, layout = _layout(spark, d)
    rows = panels.manhattan_frame(g, layout.where("index <= 10"), [5.5])
    return rows.select(F.round("x_max", 3).alias("x_max"), F.round("y_max", 6).alias("y_max"), "n_off", "n_beyond")


def _hex(v: str, most: str, colour: str) -> str:
    f = f"least(1.0, {v} / {most})"
    return "concat('#', " + ", ".join(f"lpad(to_hex(cast(round(255 + ({int(colour[k : k + 2], 16)} - 255) * {f}) AS bigint)), 2, '0')" for k in (0, 2, 4)) + ")"


@query(f"""WITH {DENSITY}, m AS (SELECT greatest(coalesce(quantile_cont(snp, 0.99) FILTER (WHERE snp > 0), 1), 1) AS ms, greatest(coalesce(quantile_cont(indel, 0.99) FILTER (WHERE indel > 0), 1), 1) AS mi FROM dens),
k AS (SELECT chr, row_number() OVER (ORDER BY cast(chr AS int)) AS place FROM sz)
SELECT chr, bin_start, 'snp' AS half, place - 0.31 AS xmin, cast(place AS double) AS xmax, (bin_start - 1) / 1e6 AS ymin, bin_end / 1e6 AS ymax, {_hex('snp', 'ms', panels.SNP_COLOUR)} AS colour FROM dens JOIN k USING (chr), m
UNION ALL SELECT chr, bin_start, 'indel', cast(place AS double), place + 0.31, (bin_start - 1) / 1e6, bin_end / 1e6, {_hex('indel', 'mi', panels.INDEL_COLOUR)} FROM dens JOIN k USING (chr), m""")
def karyotype_panel(spark, d):
    return panels.karyotype(_density(spark, d), gwas.chrom_sizes(_sites(spark, d)))


MARKS = "SELECT concat('Chr0', s_suppkey % 15 + 1) AS name, s_suppkey * 9000 AS spot FROM {supplier}"


@query(f"""WITH {DENSITY}, k AS (SELECT chr, row_number() OVER (ORDER BY cast(chr AS int)) AS place, max(length) OVER () / 1e6 AS most FROM sz), m AS (SELECT k.*, spot AS pos FROM ({duck(MARKS)}) a JOIN k ON k.chr = cast(cast(substr(name, 4) AS int) AS string)),
tri AS (SELECT * FROM (VALUES (1, 0.12, -0.012), (2, 0.12, 0.012), (3, 0.0, 0.0)) t(corner, far, up)), sides AS (SELECT * FROM (VALUES ('left', -1), ('right', 1)) t(side, way))
SELECT chr, pos, side, corner, round(cast(place + way * (0.31 + far) AS double), 8) AS x, round(cast(pos / 1e6 + up * most AS double), 8) AS y FROM m, tri, sides""")
def centromere_marks(spark, d):
    rows = panels.centromeres(view(spark, d, MARKS), gwas.chrom_sizes(_sites(spark, d)))
    return rows.withColumns({c: F.round(c, 8) for c in "xy"})


# ---- one region ----
LEAD30 = """one AS (SELECT smp, dos AS x FROM g WHERE v = 30 AND dos IS NOT NULL), z AS (SELECT v, pos, count(*) AS n, sum(x) AS sx, sum(dos) AS sy, sum(x * x) AS sxx, sum(dos * dos) AS syy, sum(x * dos) AS sxy FROM g JOIN one USING (smp) WHERE dos IS NOT NULL GROUP BY v, pos),
l30 AS (SELECT v, CASE WHEN v = 30 THEN 1.0 WHEN n >= 3 AND n * sxx - sx * sx > 1e-9 * n AND n * syy - sy * sy > 1e-9 * n THEN least(pow(n * sxy - sx * sy, 2) / (cast(n * sxx - sx * sx AS double) * cast(n * syy - sy * sy AS double)), 1.0) END AS r2 FROM z)"""
LD_GWAS = "SELECT concat('V', v) AS snp, '1' AS chr, v * 700 + 1 AS pos, (v * 37 % 101 + 1) / cast(103 AS double) AS p FROM (SELECT DISTINCT l_partkey AS v FROM {lineitem}) x"


def _ld_gwas(spark, d):
    return view(spark, d, LD_GWAS).withColumn("logp", -F.log10("p"))


@query(f"""WITH {PAIRS}, {LEAD30}, w AS (SELECT * FROM ({duck(LD_GWAS)}) WHERE pos BETWEEN 7001 AND 140000), j AS (SELECT w.*, -log10(p) AS logp, round(r2, 6) AS r2 FROM w LEFT JOIN l30 ON w.snp = concat('V', l30.v))
SELECT snp, pos, round(logp, 6) AS logp, r2, CASE WHEN r2 IS NULL THEN 'no LD data' WHEN r2 <= 0.2 THEN '0-0.2' WHEN r2 <= 0.4 THEN '0.2-0.4' WHEN r2 <= 0.6 THEN '0.4-0.6' WHEN r2 <= 0.8 THEN '0.6-0.8' ELSE '0.8-1' END AS bin, snp = 'V30' AS is_lead,
row_number() OVER (ORDER BY r2 IS NOT NULL, r2, pos, snp) AS draw, round(greatest(max(logp) OVER (), 3.5) * 1.18, 6) AS y_max FROM j""")
def regional_panel(spark, d):
    r2 = genotypes.r2_with_lead(_blk(spark, d), 30).select(F.concat(F.lit("V"), "v").alias("snp"), F.round("r2", 6).alias("r2"))
    rows = panels.regional(_ld_gwas(spark, d), LD_HERE, "V30", r2, 3.5)
    return rows.withColumns({c: F.round(c, 6) for c in ("logp", "y_max")})


@query()
def gene_row_panel(spark, d):
    """Packing is a sequential choice; tested against a plain loop."""
    return panels.gene_rows(view(spark, d, s.GENES).withColumnRenamed("note", "name"), 1_000_000.0)


THINNED = """w AS (SELECT DISTINCT v, pos, '1' AS chr FROM g WHERE pos BETWEEN 7001 AND 140000), r AS (SELECT v, pos, row_number() OVER (ORDER BY pos, concat('V', v)) AS r, count(*) OVER () AS n FROM w),
t AS (SELECT v, pos, row_number() OVER (ORDER BY pos, concat('V', v)) AS k, count(*) OVER () AS m FROM r WHERE n <= 60 OR v = 30 OR r IN (SELECT cast(round_even(1 + t * (n - 1) / 59.0, 0) AS bigint) FROM generate_series(0, 59) s(t)))"""


@query(f"""WITH {PAIRS}, {THINNED}
SELECT concat('V', a.v) AS id_a, concat('V', b.v) AS id_b, round(0.007001 + ((a.k + b.k) / 2.0 - 0.5) * 0.132999 / a.m, 8) AS cx, cast(a.k - b.k AS double) AS cy, round(0.132999 / a.m / 2, 8) AS half, round(r2, 6) AS value
FROM ld JOIN t a ON ld.i = a.v JOIN t b ON ld.j = b.v""")
def ld_diamond_panel(spark, d):
    pairs = genotypes.r2(_blk(spark, d), 20_000).select(F.concat(F.lit("V"), "i").alias("id_a"), F.concat(F.lit("V"), "j").alias("id_b"), F.round("r2", 6).alias("value"))
    variants = _blk(spark, d).select(F.concat(F.lit("V"), "v").alias("id"), "chr", "pos").distinct()
    return panels.ld_diamonds(pairs, variants, LD_HERE, 60, "V30").withColumns({"cx": F.round("cx", 8), "half": F.round("half", 8)})


OUTLINED = "SELECT '1' AS chr, s_suppkey * 900 + 2001 AS start, s_suppkey * 900 + s_suppkey % 9 * 1400 AS `end` FROM {supplier}"


@query(f"""WITH g AS ({duck(s.GENO_BLK)}), {THINNED}, b AS ({duck(OUTLINED)}), e AS (SELECT start, "end", min(k) AS a, max(k) AS z, any_value(m) AS m FROM b JOIN t ON pos BETWEEN start AND "end" WHERE start <= 140000 AND "end" >= 7001 GROUP BY start, "end" HAVING count(*) > 1),
p AS (SELECT start, "end" AS gend, 0.007001 + (a - 0.5) * 0.132999 / m AS xa, 0.007001 + (z - 0.5) * 0.132999 / m AS xz, cast(a - z - 1 AS double) AS low FROM e)
SELECT start, gend, round(xa, 8) AS x, cast(-1.0 AS double) AS y, round((xa + xz) / 2, 8) AS xend, low AS yend FROM p UNION ALL SELECT start, gend, round((xa + xz) / 2, 8), low, round(xz, 8), cast(-1.0 AS double) FROM p""")
def ld_block_outline(spark, d):
    variants = _blk(spark, d).select(F.concat(F.lit("V"), "v").alias("id"), "chr", "pos").distinct()
    lines = panels.ld_outlines(view(spark, d, OUTLINED), variants, LD_HERE, 60, "V30")
    return lines.select("start", F.col("end").alias("gend"), F.round("x", 8).alias("x"), "y", F.round("xend", 8).alias("xend"), "yend")


@query(f"WITH {G}, a AS ({duck(s.REGIONS)}) SELECT region_id AS label, r_start AS start, r_end AS gend, round((greatest(r_start, 50001) + least(r_end, 400000)) / 2e6, 8) AS label_x FROM a WHERE r_chr = '3' AND r_end >= 50001 AND r_start <= 400000")
def track_panel(spark, d):
    rows = view(spark, d, s.REGIONS).select(F.concat(F.lit("chr0"), "r_chr").alias("chr"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("region_id").alias("label"))
    return panels.track(rows, HERE).select("label", "start", F.col("end").alias("gend"), F.round("label_x", 8).alias("label_x"))


@query(f"""WITH {CAND} SELECT cand.vid, gene_id, CASE WHEN location IN ('upstream', 'downstream') THEN location WHEN location = 'intron' OR location = 'genic' THEN 'intron' WHEN feature = 'non-coding exon' THEN 'exon (non-coding part)' ELSE feature END AS place FROM cand""")
def variant_place(spark, d):
    genes = view(spark, d, s.GENES)
    near = intervals.range_join(view(spark, d, s.VARIANTS).select("vid", "chr", "pos"), genes.withColumns({"start": F.col("start") - 3000, "end": F.col("end") + 3000}))
    here = near.select("vid", "pos", "gene_id", (F.col("start") + 3000).alias("s"), (F.col("end") - 3000).alias("e"), "strand")
    down = F.when(F.col("strand") == "-", F.col("s") - F.col("pos")).otherwise(F.col("pos") - F.col("e"))
    here = here.where(down <= 1000).select("vid", "pos", "gene_id")
    features = view(spark, d, s.FEATURES).withColumnsRenamed({"f_start": "start", "f_end": "end"})
    return panels.variant_location(here, genes, features).select("vid", "gene_id", "place")


@query(f"""SELECT gene_id, CASE strand WHEN '-' THEN "end" ELSE start END AS tss, round(cast(0.3 AS double) - length(note) % 5, 4) AS y0, round(cast(0.58 AS double) - length(note) % 5, 4) AS y1, cast(CASE strand WHEN '-' THEN "end" - 45000 ELSE start + 45000 END AS double) AS xend FROM ({duck(s.GENES)}) g""")
def tss_panel(spark, d):
    rows = panels.tss_arrows(view(spark, d, s.GENES).withColumn("row", F.length("note") % 5), 1_000_000.0)
    return rows.select("gene_id", "tss", F.round("y0", 4).alias("y0"), F.round("y1", 4).alias("y1"), "xend")


# ---- reports ----
@query(f"""WITH {G}, r AS ({duck(s.REGIONS)}), h AS (SELECT region_id AS region, genes.* FROM r JOIN genes ON r_chr = chr AND start <= r_end AND "end" >= r_start)
SELECT region, gene_id, "end" - start + 1 AS length_bp, cast((SELECT min(greatest(h.start - pos, pos - h."end", 0)) FROM v WHERE v.chr = h.chr) AS bigint) AS distance_bp FROM h""")
def region_genes(spark, d):
    genes = view(spark, d, s.GENES).withColumn("name", F.col("gene_id"))
    rows = report.genes_of_regions(view(spark, d, s.REGIONS), genes, None, view(spark, d, s.VARIANTS).select("chr", "pos"))
    return rows.select("region", "gene_id", "length_bp", "distance_bp")


@query(f"WITH {PAIRS} SELECT concat('V', i) AS snp_a, pos_i AS pos_a, concat('V', j) AS snp_b, pos_j AS pos_b, pos_j - pos_i AS dist_bp, round(r2, 4) AS r2 FROM ld WHERE r2 IS NULL OR round(r2, 4) >= 0.2")
def ld_pairs_table(spark, d):
    pairs = genotypes.r2(_blk(spark, d), 20_000).select(F.concat(F.lit("V"), "i").alias("snp_a"), F.col("pos_i").alias("pos_a"), F.concat(F.lit("V"), "j").alias("snp_b"), F.col("pos_j").alias("pos_b"), "r2")
    return report.ld_pairs_table(pairs, "r2", 4, 0.2)


@query("""WITH d AS (SELECT cast(date_trunc('day', ts) AS timestamp) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, kind, n FROM d""")
def events_by_day(spark, d):
    rows = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    start, kind, n = rows.columns
    return rows.select(F.date_format(F.col(start), "yyyy-MM-dd").alias("day"), F.col(kind).alias("kind"), F.col(n).alias("n"))


@query()
def tree_panel(spark, d):
    """Coordinates of a tree; tested by the lengths of its branches."""
    names, dist = tree.distance_matrix(genotypes.distances(_blk(spark, d)))
    return panels.tree_panel(spark, tree.midpoint_root(tree.neighbor_joining(names, dist)), "circular", panels.cluster_groups(names, dist, 4))
