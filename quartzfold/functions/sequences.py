"""Column functions over protein sequences, token patterns and variant ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartzfold.constants import AA20, BETA, COIL, EXTENDED, HELIX, HEPTAD, HEPTAD_ROLE, HYDROPATHY, HYDROPHOBIC, POLAR, SPECIAL, TOKEN_OF, TOKENS


def letters(text: Column) -> Column:
    """The characters of a string as an array; empty for an empty string."""
    return F.slice(F.split(text, ""), F.lit(1), F.length(text))


def is_valid_protein(seq: Column, gaps: bool = False, stop: bool = False) -> Column:
    """Whether a trimmed sequence, in either case, has only letters (with ``gaps`` also ``-`` and ``.``, with ``stop`` also ``*``)."""
    return F.upper(F.trim(seq)).rlike(f"^[{EXTENDED}{'*' if stop else ''}{'.-' if gaps else ''}]*$")


def bad_letters(text: Column, allowed: str) -> Column:
    """The different characters of ``text`` outside ``allowed``, sorted."""
    return F.array_sort(F.array_distinct(letters(F.regexp_replace(text, f"[{allowed}]", ""))))


def _listed(found: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(found, "', '"), F.lit("']"))


def natural_reason(seq: Column) -> Column:
    """Why a sequence can't be a natural template: null for a valid one. An empty one is not valid."""
    s = F.upper(F.trim(seq))
    bad = bad_letters(s, AA20)
    unknown = bad_letters(s, EXTENDED)
    return (
        F.when(seq.isNull() | (s == ""), "Empty sequence")
        .when(F.size(unknown) > 0, F.concat(F.lit("Invalid characters: "), _listed(unknown)))
        .when(F.size(bad) > 0, F.concat(F.lit("Non-canonical/ambiguous residues present (AA20-only required): "), _listed(bad)))
    )


def token_reason(pattern: Column, allowed: str = TOKENS) -> Column:
    """Why a token pattern is not valid: null for a valid one. Case counts; blanks don't. ``allowed`` may be ``HP`` alone."""
    p = F.replace(F.trim(pattern), F.lit(" "), F.lit(""))
    first = F.regexp_extract(p, f"[^{allowed}]", 0)
    return F.when(pattern.isNull() | (p == ""), "Empty token pattern").when(first != "", F.concat(F.lit("Invalid token '"), first, F.lit("'")))


def tokens(seq: Column) -> Column:
    """Each residue as its token: hydrophobic H, polar P, proline p, cysteine c, glycine g; same length."""
    order = HYDROPHOBIC + POLAR + SPECIAL
    return F.translate(seq, order, "".join(TOKEN_OF[a] for a in order))


def pool(spelling: Column) -> Column:
    """The residues of a pool as written: letters in order, whatever parts them, upper case, each once."""
    return F.array_distinct(letters(F.regexp_replace(F.upper(spelling), "[^A-Z]", "")))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row, also where ``f`` uses it for each element of an array."""
    return F.transform(F.array(value), f)[0]


DRAWS = 8  # numbers of four hexadecimal digits that one MD5 gives


def digests(n: Column, *key: Column) -> Column:
    """Hexadecimal digits for ``n`` draws, an MD5 for eight each: of the key's parts and the block's number, the same in any engine, whatever the order of rows."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(n / DRAWS).cast("int") - 1, F.lit(0)))
    return once(text, lambda k: F.transform(blocks, lambda b: F.md5(F.concat_ws("|", k, b.cast("string")))))


def drawn(digits: Column, i: Column, n: Column) -> Column:
    """The ``i``-th draw (from 0): a number from 0 to n - 1."""
    block = F.get(digits, F.floor(i / DRAWS).cast("int"))
    return F.pmod(F.conv(block.substr(4 * (i % DRAWS) + 1, F.lit(4)), 16, 10).cast("int"), n)


def instantiate(pattern: Column, hydrophobic: Column, polar: Column, *key: Column) -> Column:
    """A sequence for a token pattern: H and P become a residue of their pool, chosen by key and position; p, c, g stay fixed."""
    given = F.struct(digests(F.length(pattern), *key).alias("d"), hydrophobic.alias("h"), polar.alias("p"))
    pick = lambda g, p, i: F.element_at(g[p], drawn(g["d"], i, F.size(g[p])) + 1)
    made = lambda g: F.transform(letters(pattern), lambda t, i: F.when(t == "H", pick(g, "h", i)).when(t == "P", pick(g, "p", i)).otherwise(F.upper(t)))
    return once(given, lambda g: F.array_join(made(g), ""))


def recovery(natural: Column, variant: Column) -> Column:
    """The share of positions at which two sequences of one length agree; null for other or empty ones."""
    same = F.aggregate(F.zip_with(letters(natural), letters(variant), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(natural) == F.length(variant)) & (F.length(natural) > 0), same / F.length(natural).cast("double"))


def variant_id(template: Column, index: Column, prefix: str = "var") -> Column:
    """``<template>_var0007``: four digits at least."""
    return F.format_string(f"%s_{prefix}%04d", template, index)


def default_group(variant: Column) -> Column:
    """The text before the first ``_var``, else the id."""
    return F.substring_index(variant, "_var", 1)


def hydropathy(residue: Column, default: float | None = None) -> Column:
    """Kyte-Doolittle hydropathy of a residue letter; ``default`` for other letters."""
    table = F.create_map(*[F.lit(x) for pair in HYDROPATHY.items() for x in pair])
    return F.coalesce(F.element_at(table, F.upper(residue)), F.lit(default).cast("double"))


def heptad_position(at: Column, start: str = "a") -> Column:
    """The heptad letter of a 0-based position, counted from ``start``."""
    return F.element_at(F.array(*map(F.lit, HEPTAD)), (F.pmod(at + HEPTAD.index(start), F.lit(7)) + 1).cast("int"))


def heptad_role(position: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in HEPTAD_ROLE.items() for x in pair]), position)


def structure_class(letter: Column) -> Column:
    """helix, beta or coil for a secondary-structure letter."""
    return F.when(letter.isin(*HELIX), "helix").when(letter.isin(*BETA), "beta").when(letter.isin(*COIL), "coil")


def motif_positions(seq: Column, motif: str) -> Column:
    """The 1-based positions that any hit of ``motif`` covers, overlapping hits included, in order; case doesn't count."""
    m = len(motif)
    if not m:
        return F.array().cast("array<int>")
    s = F.upper(seq)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq) - m + 1, F.lit(1))), lambda i: s.substr(i, F.lit(m)) == motif.upper())
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + m - 1)))))


def masked_length(seq: Column, positions: Column) -> Column:
    """The number of residues that are not at the given positions."""
    return F.length(seq) - F.size(positions)


def effective_length(length: Column, most: int | None = None) -> Column:
    """The residues a model of ``most`` tokens can take; two tokens mark the ends."""
    return length if most is None else F.least(length, F.lit(most - 2))


def wrap(text: Column, width: int = 80) -> Column:
    """The text in lines of ``width`` characters."""
    return F.rtrim(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
