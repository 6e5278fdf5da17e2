"""The sequence functions as SQL functions of a session: SELECT rev_comp(s), LATERAL kmers(s, 12), TABLE arguments.

Scalars are SQL expressions that the optimiser puts in place, so they cost what their column forms cost.  Each is listed once,
with its column form, which a test holds it to.  Formats that need a walk with state are Python table functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..shipping import ship
from . import sequences as S


@dataclass(frozen=True)
class Scalar:
    """arguments and returns in SQL, body in SQL, and the column form that gives the same."""

    name: str
    arguments: str
    returns: str
    body: str
    column: Callable[..., Column]


def _ends(gc: float, at: float) -> str:
    return " + ".join(f"CASE WHEN {end} IN ('G', 'C') THEN {gc}D ELSE {at}D END" for end in ("substr(s, 1, 1)", "substr(s, length(s), 1)"))


def _dimers(weights: dict[str, float]) -> str:
    return " + ".join(["0.0D", *(f"regexp_count(s, '(?={d})') * {w}D" for d, w in weights.items())])


_CODON = "CASE WHEN c RLIKE '^[TCAG]{3}$' THEN " + " + ".join(f"(instr('{S.BASES}', substr(c, {k + 1}, 1)) - 1) * {16 // 4**k}" for k in range(3)) + " END"
_SALT = f"ln({S.CATION_MOLAR}D)"
_PLAIN = f"nn_enthalpy(s) * 1000 / (nn_entropy(s) + {S.GAS_CONSTANT}D * ln({S.PRIMER_MOLAR:.7f}D))"

#: Steps that other bodies call.
STEPS = {
    "nn_enthalpy(s STRING) RETURNS DOUBLE": f"{_dimers(S.DIMER_H)} + {_ends(S.END_GC_H, S.END_AT_H)}",
    "nn_entropy(s STRING) RETURNS DOUBLE": f"{_dimers(S.DIMER_S)} + {_ends(S.END_GC_S, S.END_AT_S)}",
    "codon_index(c STRING) RETURNS INT": _CODON,
}

SCALARS = [
    Scalar("sequence_key", "s STRING", "STRING", r"upper(regexp_replace(coalesce(s, ''), r'\s+', ''))", S.sequence_key),
    Scalar(
        "rev_comp", "s STRING", "STRING",
        f"reverse(translate(regexp_replace(upper(s), '[^{S.COMPLEMENT_FROM}]', 'N'), '{S.COMPLEMENT_FROM}', '{S.COMPLEMENT_TO}'))", S.rev_comp,
    ),
    Scalar("gc_fraction", "s STRING", "DOUBLE", "CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^gcGC]', '')) / length(s) END", S.gc_fraction),
    Scalar(
        "guess_molecule", "s STRING", "STRING",
        f"CASE WHEN coalesce(s, '') = '' OR length(regexp_replace(upper(s), '[^{S.DNA_LETTERS}]', '')) / length(s) > 0.9 THEN 'dna' ELSE 'protein' END", S.guess_molecule,
    ),
    Scalar("bad_letters", "s STRING", "STRING", f"array_join(slice(array_distinct(split(regexp_replace(sequence_key(s), '[{S.DNA_LETTERS}]', ''), '')), 1, 5), '')", S.bad_letters),
    Scalar("bad_residues", "s STRING", "STRING", f"array_join(slice(array_distinct(split(regexp_replace(sequence_key(s), '[{S.QUERY_PROTEIN_LETTERS}]', ''), '')), 1, 5), '')", lambda s: S.bad_letters(s, protein=True)),
    Scalar("in_window", "p BIGINT, a BIGINT, b BIGINT", "BOOLEAN", "CASE WHEN a <= b THEN p BETWEEN a AND b ELSE p >= a OR p <= b END", S.in_window),
    Scalar("wraps_origin", "a BIGINT, b BIGINT, circular BOOLEAN", "BOOLEAN", "coalesce(circular AND b < a, false)", S.wraps_origin),
    Scalar(
        "derive_bases", "s STRING, a INT, b INT, strand INT, circular BOOLEAN", "STRING",
        "coalesce(CASE WHEN strand = -1 THEN rev_comp(spanned(s, a, b, circular)) ELSE spanned(s, a, b, circular) END, '')", S.derive_bases,
    ),
    Scalar(
        "melting_point", "t STRING", "DOUBLE",
        "melting(upper(trim(t)))", S.melting_point,
    ),
    Scalar("translate_codon", "codon STRING", "STRING", f"coalesce(substr('{S.GENETIC_CODE}', codon_index(translate(upper(codon), 'U', 'T')) + 1, 1), '')", S.translate_codon),
    Scalar(
        "verdict", "m BIGINT, c BIGINT, n BIGINT", "STRING",
        "CASE WHEN m IS NULL THEN NULL WHEN m > 0 OR coalesce(c, 0) < 50 THEN 'mismatch' WHEN n > 0 AND coalesce(c, 0) = n THEN 'match' ELSE 'partial match' END", S.verdict,
    ),
    Scalar(
        "identity_label", "c BIGINT, x BIGINT, g BIGINT", "STRING",
        "CASE WHEN coalesce(c, 0) + coalesce(g, 0) = 0 THEN '' ELSE concat(format_string('%.1f', floor(1000 * (coalesce(c, 0) - coalesce(x, 0)) / greatest(coalesce(c, 0) + coalesce(g, 0), 1)) / 10), '% identical') END",
        S.identity_label,
    ),
    Scalar(
        "column_number", "r STRING", "BIGINT",
        "aggregate(filter(split(upper(regexp_replace(r, '[^A-Za-z]', '')), ''), c -> c <> ''), 0L, (n, c) -> n * 26 + ascii(c) - 64) - 1", S.column_number,
    ),
    Scalar(
        "natural_key", "name STRING", "STRING",
        r"array_join(transform(regexp_extract_all(lower(name), r'(\d+|\D+)', 1), t -> CASE WHEN t RLIKE r'^\d+$' THEN lpad(regexp_replace(t, '^0+(?=.)', ''), 20, '0') ELSE t END), '')", S.natural_key,
    ),
    Scalar("strand_word", "strand INT", "STRING", "CASE WHEN strand = -1 THEN 'reverse' ELSE 'forward' END", S.strand_word),
    Scalar("coordinates", "a BIGINT, b BIGINT, wraps BOOLEAN", "STRING", "coalesce(concat(a + 1, '..', b + 1, CASE WHEN wraps THEN ' (wraps origin)' ELSE '' END), '')", S.coordinates),
    Scalar(
        "leading_number", "s STRING", "DOUBLE",
        r"try_cast(nullif(regexp_extract(s, r'^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') AS DOUBLE)", S.leading_number,
    ),
    Scalar("degap", "s STRING", "STRING", "regexp_replace(s, '[-.]', '')", lambda s: F.regexp_replace(s, "[-.]", "")),
]

#: Steps that call scalars that are listed before those that call them.
INNER = {
    "spanned(s STRING, a INT, b INT, circular BOOLEAN) RETURNS STRING": (
        "upper(CASE WHEN b >= a THEN substr(s, a + 1, b - a + 1) WHEN circular THEN concat(substr(s, a + 1), substr(s, 1, b + 1)) ELSE substr(s, b + 1, a - b + 1) END)"
    ),
    "melting(s STRING) RETURNS DOUBLE": (
        f"CASE WHEN length(s) >= 2 AND s RLIKE '^[ACGT]+$' THEN 1 / (1 / ({_PLAIN}) + ((4.29D * gc_fraction(s) - 3.95D) * 1e-5D * {_SALT} + pow(9.4D, -6) * {_SALT} * {_SALT})) - {S.KELVIN}D END"
    ),
    "translate_frame(s STRING, o INT) RETURNS STRING": (
        f"array_join(transform(regexp_extract_all(substr(s, o + 1), '...', 0), c -> coalesce(substr('{S.GENETIC_CODE}', {_CODON} + 1, 1), 'X')), '')"
    ),
}
TABLES = {
    "kmers(s STRING, k INT) RETURNS TABLE (at INT, kmer STRING)": "SELECT i, substr(s, i + 1, k) FROM (SELECT explode(CASE WHEN length(s) >= k THEN sequence(0, length(s) - k) END) AS i)",
    "six_frames(s STRING) RETURNS TABLE (strand INT, frame INT, protein STRING)": (
        "SELECT f.strand, f.strand * (f.o + 1), translate_frame(CASE WHEN f.strand > 0 THEN s ELSE rev_comp(s) END, f.o)"
        " FROM (SELECT explode(array(" + ", ".join(f"named_struct('strand', {d}, 'o', {o})" for d in (1, -1) for o in range(3)) + ")) AS f)"
    ),
}


class FastaRecords:
    """fasta_records(TABLE(lines)): path, record (from 0), name, sequence of lines (path, line_no, line).

    The function itself asks for one path at a time in order of lines; one record of it is held.  Lines before the first
    mark and null lines are passed over.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        missing = {"path", "line_no", "line"} - set(getattr(lines.dataType, "names", []))
        if not lines.isTable or missing:
            raise ValueError(f"fasta_records takes TABLE(path, line_no, line); missing: {', '.join(sorted(missing)) or 'TABLE'}")
        kind = lines.dataType["path"].dataType
        schema = T.StructType().add("path", kind).add("record", T.IntegerType()).add("name", T.StringType()).add("sequence", T.StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.path, self.number, self.name, self.parts = None, -1, "", []

    def eval(self, row: T.Row) -> Iterator[tuple]:
        line = (row["line"] or "").strip()
        self.path = row["path"]
        if line.startswith(">"):
            yield from self.terminate()
            self.number, self.name, self.parts = self.number + 1, line[1:].strip(), []
        elif self.number >= 0:
            self.parts.append(line)

    def terminate(self) -> Iterator[tuple]:
        if self.number >= 0:
            yield self.path, self.number, self.name, "".join(self.parts)


class SequenceTracks:
    """sequence_tracks(path, content [, molecule]): name, molecule, sequence, circular of each record of a sequence file.

    A file that can't be parsed is a row whose molecule is null and whose name is the reason.
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, molecule: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(content.dataType, T.BinaryType):
            raise ValueError("sequence_tracks takes a path and the file's bytes")
        if molecule is not None and molecule.isConstantExpression and molecule.value not in (None, "dna", "protein"):
            raise ValueError("molecule is 'dna', 'protein' or null")
        return AnalyzeResult(schema=T.StructType().add("name", "string").add("molecule", "string").add("sequence", "string").add("circular", "boolean"))

    def eval(self, path: str, content: bytes, molecule: str | None = None) -> Iterator[tuple]:
        import struct

        from ..sources.formats import parse_file

        try:
            rows = parse_file(path or "", bytes(content or b""), molecule)
        except (ValueError, struct.error, IndexError) as e:
            rows = [{"name": str(e), "molecule": None, "sequence": "", "circular": False}]
        for r in rows:
            yield r["name"], r["molecule"], r["sequence"], r["circular"]


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; those that call others follow them."""
    scalars = {s.name: (f"{s.name}({s.arguments}) RETURNS {s.returns}", s.body) for s in SCALARS}
    early = ("sequence_key", "rev_comp", "gc_fraction")
    heads = [*STEPS.items(), *(scalars[n] for n in early), *INNER.items(), *(v for n, v in scalars.items() if n not in early), *TABLES.items()]
    for head, body in heads:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    ship(spark)
    for name, cls in (("fasta_records", FastaRecords), ("sequence_tracks", SequenceTracks)):
        spark.udtf.register(name, F.udtf(cls))
