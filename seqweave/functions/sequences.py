"""Sequence functions as column expressions: they stay in the JVM, inside generated code where Spark allows.

Coordinates are 0-based and inclusive; a range that crosses the origin of a circular sequence has end < start.
A strand is 1 or -1; anything but -1 counts as 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets, complements and the standard genetic code in T, C, A, G order.
DNA_LETTERS = "ACGTURYSWKMBDHVN"
PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWYBXZJUO"
QUERY_PROTEIN_LETTERS = "ACDEFGHIKLMNPQRSTVWY*X"
COMPLEMENT_FROM = "ACGTUNRYSWKMBVDH"
COMPLEMENT_TO = "TGCAANYRSWMKVBHD"
BASES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol/K) of each dimer, and of the two ends.
DIMER_H = {
    "AA": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "GT": -8.4, "CT": -7.8, "GA": -8.2, "CG": -10.6,
    "GC": -9.8, "GG": -8.0, "TT": -7.9, "TG": -8.5, "AC": -8.4, "AG": -7.8, "TC": -8.2, "CC": -8.0,
}
DIMER_S = {
    "AA": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "GT": -22.4, "CT": -21.0, "GA": -22.2, "CG": -27.2,
    "GC": -24.4, "GG": -19.9, "TT": -22.2, "TG": -22.7, "AC": -22.4, "AG": -21.0, "TC": -22.2, "CC": -19.9,
}
END_GC_H, END_AT_H, END_GC_S, END_AT_S = 0.1, 2.3, -2.8, 4.1
GAS_CONSTANT, KELVIN, PRIMER_MOLAR, CATION_MOLAR = 1.987, 273.15, 5e-7, 0.05


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(s: Column | str) -> Column:
    """White space removed, upper case; null is ''."""
    return F.upper(F.regexp_replace(F.coalesce(_c(s), F.lit("")), r"\s+", ""))


sequence_key = clean


def rev_comp(s: Column | str) -> Column:
    """Reverse complement over the IUPAC letters; U pairs with A, other letters become N."""
    known = F.regexp_replace(F.upper(_c(s)), f"[^{COMPLEMENT_FROM}]", "N")
    return F.reverse(F.translate(known, COMPLEMENT_FROM, COMPLEMENT_TO))


def round_half_up(x: Column, digits: int = 1) -> Column:
    """Halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def bad_letters(s: Column | str, protein: bool = False, most: int = 5) -> Column:
    """The first distinct letters of a cleaned query outside its alphabet, joined; '' if it is valid."""
    letters = QUERY_PROTEIN_LETTERS if protein else DNA_LETTERS
    left = F.regexp_replace(clean(s), f"[{letters.replace('*', '')}{'*' if '*' in letters else ''}]", "")
    return F.array_join(F.slice(F.array_distinct(F.split(left, "")), 1, most), "")


def guess_molecule(s: Column | str) -> Column:
    """'dna' if over nine tenths of the letters are nucleotide codes, or there are none."""
    s = F.coalesce(_c(s), F.lit(""))
    dna = F.length(F.regexp_replace(F.upper(s), f"[^{DNA_LETTERS}]", ""))
    return F.when((F.length(s) == 0) | (dna / F.greatest(F.length(s), F.lit(1)) > 0.9), "dna").otherwise("protein")


def typed_sequence(text: Column | str, reference: Column | None = None) -> Column:
    """(sequence, reason) of a typed or pasted sequence; reason is null if it can join an alignment.

    White space, digits and one '*' at the end go.  It is held to the letters of the reference's molecule, or without one
    to those of the molecule it looks like.
    """
    stripped = F.upper(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\s\d]", ""))
    sequence = F.regexp_replace(stripped, r"\*$", "")
    looks = guess_molecule(sequence)
    protein = (looks if reference is None else F.coalesce(reference, looks)) == "protein"
    odd = lambda letters: F.length(F.regexp_replace(sequence, f"[{letters}]", "")) > 0
    reason = (
        F.when(sequence == "", "empty")
        .when(sequence.contains("*"), "stop inside")
        .when(protein & odd(PROTEIN_LETTERS), "not protein")
        .when(~protein & odd(DNA_LETTERS), "not dna")
        .when(protein & (looks == "dna"), "looks like dna")
    )
    return F.struct(sequence.alias("sequence"), reason.alias("reason"))


def gc_fraction(s: Column | str) -> Column:
    s = _c(s)
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^gcGC]", "")) / F.length(s))


def in_window(p: Column | str, start: Column | str, end: Column | str) -> Column:
    p, start, end = _c(p), _c(start), _c(end)
    return F.when(start <= end, (p >= start) & (p <= end)).otherwise((p >= start) | (p <= end))


def wraps_origin(start: Column | str, end: Column | str, circular: Column) -> Column:
    return F.coalesce(circular & (_c(end) < _c(start)), F.lit(False))


def derive_bases(s: Column | str, start: Column | str, end: Column | str, strand: Column | str, circular: Column) -> Column:
    """Upper-case bases of a range on its strand; a wrapped range of a linear sequence is read the other way round."""
    s, start, end = _c(s), _c(start), _c(end)
    forward = F.substr(s, start + 1, end - start + 1)
    across = F.concat(F.substr(s, start + 1), F.substr(s, F.lit(1), end + 1))
    swapped = F.substr(s, end + 1, start - end + 1)
    raw = F.upper(F.when(end >= start, forward).when(circular, across).otherwise(swapped))
    return F.coalesce(F.when(_c(strand) == -1, rev_comp(raw)).otherwise(raw), F.lit(""))


def melting_point(s: Column | str) -> Column:
    """Nearest-neighbour melting point in degrees C, unrounded; null for under two letters or any but ACGT.

    Sums run over dimer counts, so the order of additions is fixed.  The salt term is 9.4 to the power -6, as published.
    """
    s = F.upper(F.trim(_c(s)))
    h, e = F.lit(0.0), F.lit(0.0)
    for dimer in DIMER_H:
        n = F.regexp_count(s, F.lit(f"(?={dimer})"))
        h, e = h + n * F.lit(DIMER_H[dimer]), e + n * F.lit(DIMER_S[dimer])
    for end in (F.substr(s, F.lit(1), F.lit(1)), F.substr(s, F.length(s), F.lit(1))):
        gc = end.isin("G", "C")
        h, e = h + F.when(gc, END_GC_H).otherwise(END_AT_H), e + F.when(gc, END_GC_S).otherwise(END_AT_S)
    plain = h * 1000 / (e + GAS_CONSTANT * F.log(F.lit(PRIMER_MOLAR)))
    salt = F.log(F.lit(CATION_MOLAR))
    shift = (4.29 * gc_fraction(s) - 3.95) * 1e-5 * salt + F.pow(F.lit(9.4), F.lit(-6)) * salt * salt
    return F.when((F.length(s) >= 2) & s.rlike("^[ACGT]+$"), 1 / (1 / plain + shift) - KELVIN)


def codon_index(codon: Column) -> Column:
    """Place of a codon in the genetic code; null if it has other letters."""
    at = [F.instr(F.lit(BASES), F.substr(codon, F.lit(k + 1), F.lit(1))) - 1 for k in range(3)]
    return F.when(codon.rlike("^[TCAG]{3}$"), at[0] * 16 + at[1] * 4 + at[2])


def translate_codon(codon: Column | str) -> Column:
    """Amino acid of a codon, U read as T; '' if the codon is ambiguous or not three letters."""
    c = F.translate(F.upper(_c(codon)), "U", "T")
    return F.coalesce(F.substr(F.lit(GENETIC_CODE), codon_index(c) + 1, F.lit(1)), F.lit(""))


def translate_frame(s: Column | str, offset: int) -> Column:
    """Protein read from an offset; a codon that is not three of TCAG is X, an incomplete last one is dropped."""
    codons = F.regexp_extract_all(F.substr(_c(s), F.lit(offset + 1)), F.lit("..."), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.substr(F.lit(GENETIC_CODE), codon_index(c) + 1, F.lit(1)), F.lit("X"))), "")


def verdict(mismatches: Column | str, compared: Column | str, reference_length: Column | str, floor: int = 50) -> Column:
    m, c = _c(mismatches), F.coalesce(_c(compared), F.lit(0))
    return (
        F.when(m.isNull(), None)
        .when((m > 0) | (c < floor), "mismatch")
        .when((_c(reference_length) > 0) & (c == _c(reference_length)), "match")
        .otherwise("partial match")
    )


def identity_label(compared: Column | str, substitutions: Column | str, gaps: Column | str) -> Column:
    """Percentage of identical columns, gaps counted, cut to one decimal; '' if nothing is aligned."""
    c, s, g = (F.coalesce(_c(x), F.lit(0)) for x in (compared, substitutions, gaps))
    tenths = F.floor(1000 * (c - s) / F.greatest(c + g, F.lit(1)))
    return F.when(c + g == 0, "").otherwise(F.concat(F.format_string("%.1f", tenths / 10), F.lit("% identical")))


def column_number(ref: Column | str) -> Column:
    """Spreadsheet column letters to a 0-based number: 'BC12' is 54."""
    letters = F.split(F.upper(F.regexp_replace(_c(ref), "[^A-Za-z]", "")), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def natural_key(name: Column | str) -> Column:
    """Sorts names with numbers in them by the numbers' values, without regard to case."""
    tokens = F.regexp_extract_all(F.lower(_c(name)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(F.regexp_replace(t, "^0+(?=.)", ""), 20, "0")).otherwise(t)), "")


def strand_word(strand: Column | str) -> Column:
    return F.when(_c(strand) == -1, "reverse").otherwise("forward")


def coordinates(start: Column | str, end: Column | str, wraps: Column) -> Column:
    """Displayed range, 1-based; '' if unknown."""
    text = F.concat((_c(start) + 1).cast("string"), F.lit(".."), (_c(end) + 1).cast("string"), F.when(wraps, " (wraps origin)").otherwise(""))
    return F.coalesce(text, F.lit(""))


def leading_number(s: Column | str) -> Column:
    """The number a text starts with, null if none."""
    found = F.regexp_extract(_c(s), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")
