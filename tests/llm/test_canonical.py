from strandflow.llm import canonical as C
from strandflow.llm.queries import TAXON_MARKERS

TAXA = [
    ("1", "Barmixphamonas", "genus", None),
    ("2", "Barmixphamonas haesrulensis", "species", "Oldgenus haesrulensis|Elder name"),
    ("3", "Zaxisbrioella", "genus", None),
    ("4", "Zaxisbrioella diotomquoum", "species", None),
    ("5", "Zaxisbrioella haesrulensis", "species", None),
    ("6", "Phaexgiaceae", "family", None),
]

CASES = {
    "Barmixphamonas haesrulensis strain A-4": "2",
    "barmixphamonas HAESRULENSIS": "2",
    "Barmixphamonas%20haesrulensis": "2",
    "Barmixphamonas_haesrulensis": "2",
    " Barmixphamonas haesrulensis\n": "2",
    "Barmíxphamonas häesrulensis": "2",
    "[Barmixphamonas] haesrulensis (type)": "2",
    "Candidatus Barmixphamonas haesrulensis": "2",
    "Barmxiphamonas haesrulesis": "2",
    "haesrulensis, Barmixphamonas": "2",
    "B. haesrulensis": "2",
    "Z.haesrulensis": "5",
    "Oldgenus haesrulensis": "2",
    "O. haesrulensis": "2",
    "Elder name isolate 7": "2",
    "Zaxisbrioella diotomquoum subsp. K-1": "4",
    "Zaxisbrioella sp. L7": "3",
    "Zaxisbrioela spp.": "3",
    "g__Zaxisbrioella": "3",
    "s__Zaxisbrioella diotomquoum": "4",
    "d__A;f__Phaexgiaceae;g__Zaxisbrioella;s__Zaxisbrioella diotomquoum": "4",
    "d__A;f__Phaexgiaceae;g__Zaxisbrioella;s__": "3",
    "d__A;f__Phaexgiaceae": "6",
    "Zaxisbrioella riolthenclonae": "unmatched",
    "Elsewhere diotomquoum": "unmatched",
    "gut isolate 4297": "unmatched",
    "n/a": "unmatched",
    "?": "unmatched",
    "x" * 50_000: "unmatched",
}


def test_cases():
    r = C.Resolver(TAXA, TAXON_MARKERS)
    assert {v: r.resolve(v) for v in CASES} == CASES


def test_other_lists_need_no_words_of_taxonomy():
    """Brands and titles: an extra, a missing or a misplaced word is no other entry."""
    r = C.Resolver([("1", "Acme Coffee Roasters", None, "Acme Roasting Company"), ("2", "Blue Harbor Seafood", None, None), ("3", "Head of Data Platform", None, None), ("4", "Data Platform 2", None, None)])
    cases = {
        "ACME coffe roasters": "1", "Acme Roasters": "1", "the acme cofee roasters": "1", "roasters acme coffee": "1", "Acme Roasting Company Ltd": "1",
        "blue habror": "2", "Harbour Seafod Blue": "2", "Seafood": "unmatched", "head data platform": "3", "data platform 2": "4", "Blue Acme": "unmatched",
    }
    assert {v: r.resolve(v) for v in cases} == cases


def test_longest_mention_wins():
    r = C.Resolver([("1", "alpha", "species", None), ("2", "alpha beta", "species", None), ("3", "beta gamma", "species", None)])
    assert [k for _, _, k in r.mentions(["alpha", "beta", "gamma"])] == [("alpha", "beta")]


def test_ties_are_unmatched():
    r = C.Resolver([("1", "Aaaaaaaa bbbbbbbb", "species", None), ("2", "Aaaaaaaa bbbbbbcc", "species", None)])
    assert r.resolve("Aaaaaaaa bbbbbbbc") == "unmatched"
    assert r.resolve("A. bbbbbbbb") == "1"
    assert C.Resolver([]).resolve("anything at all") == "unmatched"


def test_errors():
    assert C.errors("abcd", "abdc", 2) == 1
    assert C.errors("abcd", "abc", 2) == 1
    assert C.errors("abcd", "wxyz", 2) == 3
    assert C.errors("", "", 2) == 0


def test_rows(spark):
    taxa = spark.createDataFrame(TAXA, "taxid string, tax_name string, tax_rank string, former_names string")
    rows = [("a", "B. haesrulensis", "9"), ("a", "B. haesrulensis", "9"), ("b", "Zaxisbrioella diotomquoum", None), ("c", None, None), ("d", "  ", None), (None, "nothing", None)]
    df = spark.createDataFrame(rows, "accession string, taxonomy string, _value string")
    got = sorted(map(tuple, C.map_values(df, taxa, "taxonomy", ["accession"], markers=TAXON_MARKERS).collect()), key=str)
    assert got == [("a", "2"), (None, "unmatched")]
    cases = spark.createDataFrame([(v, v, None) for v in CASES] + rows, "accession string, taxonomy string, _value string")
    one = {tuple(r) for r in C.map_values(cases, taxa, "taxonomy", ["accession"], markers=TAXON_MARKERS).collect()}
    assert {(v, x) for v, x in CASES.items() if v not in {t[1] for t in TAXA}} <= one
    assert {tuple(r) for r in C.map_values(cases, taxa, "taxonomy", ["accession"], markers=TAXON_MARKERS, at_once=2).collect()} == one
    assert C.map_values(df.limit(0), taxa, "taxonomy", ["accession"]).count() == 0
    assert {r.taxid for r in C.map_values(df, taxa.limit(0), "taxonomy", ["accession"]).collect()} == {"unmatched"}
