"""Scans by published definitions: open reading frames, restriction sites."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import parsed
from .search import both_strands, occurrences, residues_to_bases, six_frames

# Letters that ambiguity codes stand for, and sites of common enzymes.
AMBIGUOUS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
ENZYMES = {"AluI": "AGCT", "BamHI": "GGATCC", "EcoRI": "GAATTC", "HaeIII": "GGCC", "HindIII": "AAGCTT", "HinfI": "GANTC", "TaqI": "TCGA"}


def orf_scan(corpus: DataFrame, least: int = 20) -> DataFrame:
    """file, frame, start, end, residues of every stretch from a start codon to the first stop, in six frames, of `least` residues."""
    frames = six_frames(corpus.select("file", "sequence"))

    def run(protein: str) -> list[dict]:
        out, at = [], 0
        parts = protein.split("*")
        for part in parts[:-1]:
            m = part.find("M")
            if m >= 0 and len(part) - m >= least:
                out.append({"first": at + m, "residues": len(part) - m})
            at += len(part) + 1
        return out

    rows = parsed(frames, run, ["protein"], "first long, residues long")
    start, end = residues_to_bases(F.col("first"), F.col("residues") + 1, F.col("frame_at"), F.col("strand"), F.col("bases"))
    return rows.select("file", "frame", start.alias("start"), end.alias("end"), "residues")


def spelled(spark: SparkSession, enzymes: dict[str, str]) -> DataFrame:
    """enzyme, site: every sequence that a recognition site with ambiguity codes stands for."""
    rows = [(name, "".join(p)) for name, site in sorted(enzymes.items()) for p in product(*(AMBIGUOUS[c] for c in site.upper()))]
    return spark.createDataFrame(rows, "enzyme string, site string")


def cut_sites(corpus: DataFrame, enzymes: dict[str, str] | None = None) -> DataFrame:
    """file, enzyme, strand, start of every recognition site; circular sequences are read past their end."""
    sites = spelled(corpus.sparkSession, enzymes or ENZYMES)
    probes = both_strands(sites, "site").drop("site")
    n = F.length("sequence")
    reach = max(map(len, (enzymes or ENZYMES).values())) - 1
    pad = F.when(F.col("circular"), F.least(F.lit(reach), n)).otherwise(0)
    padded = corpus.select("file", n.alias("n"), F.concat("sequence", F.substr(F.col("sequence"), F.lit(1), pad)).alias("text"))
    found = occurrences(padded, "text", probes)
    return found.where(F.col("at") < F.col("n")).select("file", "enzyme", "strand", F.col("at").cast("long").alias("start")).distinct()
