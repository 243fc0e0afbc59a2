"""Golden values of sequence, id and helix functions, and of libraries."""

import pytest
from pyspark.sql import functions as F

from quartzfold.functions.helices import template_lengths, topology_ranges, written
from quartzfold.functions.sequences import bad_letters, default_group, heptad_position, hydropathy, instantiate, is_valid_protein, masked_length, motif_positions, natural_reason, pool, recovery, structure_class, token_reason, tokens, variant_id, wrap
from quartzfold.operators.library import LibrarySpec, generate, generate_in_sequence, last_of, require_unique, templates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: tokens(F.lit("FSDHPCG")), "HPPPpcg"),
        (lambda: natural_reason(F.lit("HHXPH")), "Non-canonical/ambiguous residues present (AA20-only required): ['X']"),
        (lambda: natural_reason(F.lit("AC1D2")), "Invalid characters: ['1', '2']"),
        (lambda: natural_reason(F.lit(" acd ")), None),
        (lambda: natural_reason(F.lit("")), "Empty sequence"),
        (lambda: natural_reason(F.lit(None).cast("string")), "Empty sequence"),
        (lambda: token_reason(F.lit("HPpcg")), None),
        (lambda: token_reason(F.lit("HPG")), "Invalid token 'G'"),
        (lambda: token_reason(F.lit("hhp")), "Invalid token 'h'"),
        (lambda: token_reason(F.lit(" ")), "Empty token pattern"),
        (lambda: bad_letters(F.lit("ZAXZ"), "A"), ["X", "Z"]),
        (lambda: is_valid_protein(F.lit("ac-d*"), gaps=True, stop=True), True),
        (lambda: is_valid_protein(F.lit("ac-d")), False),
        (lambda: variant_id(F.lit("t"), F.lit(7)), "t_var0007"),
        (lambda: variant_id(F.lit("t"), F.lit(12345)), "t_var12345"),
        (lambda: default_group(F.lit("a_var0001")), "a"),
        (lambda: default_group(F.lit("x")), "x"),
        (lambda: motif_positions(F.lit("AGGGGGGGA"), "gggggg"), [2, 3, 4, 5, 6, 7, 8]),
        (lambda: motif_positions(F.lit("AAAA"), "GGGGGG"), []),
        (lambda: motif_positions(F.lit(""), "GG"), []),
        (lambda: motif_positions(F.lit("AAAA"), ""), []),
        (lambda: masked_length(F.lit("AGGA"), motif_positions(F.lit("AGGA"), "GG")), 2),
        (lambda: recovery(F.lit("AAAA"), F.lit("AABA")), 0.75),
        (lambda: recovery(F.lit("AAAA"), F.lit("A")), None),
        (lambda: recovery(F.lit(""), F.lit("")), None),
        (lambda: pool(F.lit(" f; L,i|F ")), ["F", "L", "I"]),
        (lambda: hydropathy(F.lit("i")), 4.5),
        (lambda: hydropathy(F.lit("x"), 0.0), 0.0),
        (lambda: heptad_position(F.lit(8), "g"), "a"),
        (lambda: structure_class(F.lit("G")), "helix"),
        (lambda: wrap(F.lit("abcdef"), 3), "abc\ndef"),
        (lambda: written(topology_ranges(F.lit("demo_len_75|helices|15,18,12,16|loops|5,4,5|x"), 8)), "4-11;26-33;45-52;64-71"),
        (lambda: written(topology_ranges(F.lit("demo_len_75|helices|15,18,12,16|loops|5,4,5|x"), None)), "1-15;21-38;43-54;60-75"),
        (lambda: template_lengths(F.lit("demo_len_74|helices|15,18,12,16|loops|5,4,5|x"))["reason"], "stated length is not the sum"),
        (lambda: template_lengths(F.lit("loops|5,4,5|helices|15,18,12,16"))["reason"], None),
        (lambda: template_lengths(F.lit("demo|helices|15,18,12|loops|5,4,5"))["reason"], "no helix lengths"),
        (lambda: template_lengths(F.lit("demo|helices|15,18,1x,2|loops|5,4,5"))["reason"], "no helix lengths"),
        (lambda: template_lengths(F.lit("demo|helices|15,18,12,16|loops"))["reason"], "no loop lengths"),
        (lambda: template_lengths(F.lit("demo|helices|15,0,12,16|loops|5,4,5"))["reason"], "helix lengths must be positive"),
        (lambda: template_lengths(F.lit("plain"))["reason"], "no helix lengths"),
        (lambda: written(topology_ranges(F.lit("plain"))), None),
    ],
)
def test_golden(spark, column, wanted):
    assert one(spark, column()) == wanted


SPEC = LibrarySpec(tuple("FLIMV"), tuple("EDKNQH"), variants=5, seed=123)
RECORDS = "rec_no int, id string, description string, seq string"


def test_library(spark):
    records = spark.createDataFrame([(1, "t", "", "HHPPgcpHPP"), (2, "bad", "", "HX")], RECORDS)
    t = templates(records, "token")
    assert [r["sequence"] for r in generate_in_sequence(t, SPEC).orderBy("variant_index").collect()] == ["FIENGCPIEE", "MVQKGCPIED", "LIQKGCPLDE", "MFQNGCPFEK", "MFEEGCPLDE"]
    made = generate(t, SPEC).collect()
    assert len(made) == 5 and all(r["sequence"][4:7] == "GCP" and r["sequence"][0] in "FLIMV" and r["sequence"][2] in "EDKNQH" for r in made)
    assert sorted(r["sequence"] for r in made) == sorted(r["sequence"] for r in generate(t.repartition(3), SPEC).collect())
    natural = templates(spark.createDataFrame([(1, "n", "", "acdef")], RECORDS), "natural")
    assert all(0 <= r["recovery_to_natural"] <= 1 for r in generate(natural, SPEC).collect())
    assert generate(t.where("false"), SPEC).count() == 0


def test_settings_and_keys(spark):
    for bad in ({"hydrophobic": ()}, {"polar": ("F",)}, {"variants": 0}, {"hydrophobic": ("X",)}):
        with pytest.raises(ValueError):
            LibrarySpec(**{"hydrophobic": ("F",), "polar": ("E",), **bad})
    twice = spark.createDataFrame([(1, "a", "", "x"), (2, "b", "", "y"), (3, "a", "", "z")], RECORDS)
    with pytest.raises(ValueError):
        require_unique(twice, "id")
    assert {r["id"]: (r["seq"], r["first_place"]) for r in last_of(twice, "id", "rec_no").collect()} == {"a": ("z", 1), "b": ("y", 2)}


def test_choice_is_free_of_order(spark):
    c = instantiate(F.lit("HP"), F.array(F.lit("A"), F.lit("V")), F.array(F.lit("K")), F.lit(1), F.lit("t"))
    assert one(spark, c) in ("AK", "VK")
