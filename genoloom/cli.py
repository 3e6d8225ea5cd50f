"""Command line: ``python -m genoloom --gwas FILE [options]`` writes the report of a locus, ``check`` and ``tree`` as first words do those."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession

from genoloom.functions.genomes import species
from genoloom.operators.checks import check_inputs
from genoloom.plans.locus import PANELS, TABLES, LocusConfig, choice, locus, write
from genoloom.plans.trees import sample_tree
from genoloom.sources import sinks

NUMBERS = {"int": int, "int | None": int, "float": float}


def _bool(text: str) -> bool:
    low = text.lower()
    if low not in ("true", "t", "yes", "1", "false", "f", "no", "0"):
        raise argparse.ArgumentTypeError(f"{text} is neither true nor false")
    return low in ("true", "t", "yes", "1")


def _value(text: str) -> str | float:
    """A number where the text is one."""
    try:
        return float(text)
    except ValueError:
        return text


def parser() -> argparse.ArgumentParser:
    """One option a field of LocusConfig, by its name with dashes."""
    p = argparse.ArgumentParser(prog="genoloom", description="Report of an association locus.", allow_abbrev=False)
    for f in dataclasses.fields(LocusConfig):
        kind = NUMBERS.get(str(f.type), str)
        how: dict[str, object] = {"type": kind}
        if f.type == "bool":
            how = {"type": _bool, "nargs": "?", "const": True}
        elif f.name in ("threshold", "suggestive"):
            how = {"type": _value}
        elif f.name == "chr_map":
            how = {"type": lambda text: dict(kv.split("=", 1) for kv in text.split(",")), "metavar": "A=1,B=2"}
        p.add_argument("--" + f.name.replace("_", "-"), dest=f.name, required=f.name == "gwas", default=argparse.SUPPRESS, **how)
    p.add_argument("--out", "--output", dest="out", default="locus", help="path that all files' names begin with")
    return p


def config(args: list[str]) -> tuple[LocusConfig, str]:
    got = vars(parser().parse_args(args))
    base = got.pop("out").removesuffix(".pdf")
    if "species" in got:
        got["species"] = species(got["species"])
    for name, known in (("panels", PANELS), ("tables", TABLES)):
        if name in got:
            got[name] = choice(got[name], known)
    return LocusConfig(**got), base


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    """The files written, by name; ``check`` prints its findings and ``tree`` writes a Newick file."""
    args = sys.argv[1:] if args is None else args
    if args[:1] in (["check"], ["tree"]):
        p = argparse.ArgumentParser(prog=f"genoloom {args[0]}", allow_abbrev=False)
        if args[0] == "check":
            for name in ("gwas", "gff", "vcf", "hapmap", "species"):
                p.add_argument("--" + name)
            p.add_argument("--window", type=int, default=50_000)
        else:
            p.add_argument("--genotypes", required=True)
            p.add_argument("--out", default="tree")
            p.add_argument("--method", choices=("nj", "upgma"), default="nj")
            p.add_argument("--distance", choices=("ibs", "euclidean"), default="ibs")
            p.add_argument("--max-snps", type=int, default=20_000)
        got = vars(p.parse_args(args[1:]))
        spark = spark or SparkSession.builder.appName("genoloom").getOrCreate()
        if args[0] == "check":
            found = check_inputs(spark, **{**got, "species": species(got["species"]) if got["species"] else None})
            for r in found.collect():
                print(f"{r.file:<8} {r.status:<8} {r.message}")
            return {}
        made = sample_tree(spark, got["genotypes"], got["method"], got["distance"], got["max_snps"])
        return {"newick": sinks.write_newick(spark, made, got["out"] + ".nwk")}
    settings, base = config(args)
    spark = spark or SparkSession.builder.appName("genoloom").getOrCreate()
    files = write(locus(spark, settings), base)
    for name, path in files.items():
        print(f"{name:<16} {path}")
    return files
