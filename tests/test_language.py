from __future__ import annotations

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from allelake.plans import filters
from allelake.plans import language as L

WORD = st.text(st.characters(categories=["Lu", "Ll", "Nd"]), min_size=1, max_size=8)


@given(st.lists(WORD, min_size=1, max_size=5), st.sampled_from([L.AND, L.OR]))
def test_terms(values, by):
    found = L.terms(by.join(values))
    assert found.values == tuple(values) and found.joined_by == (by if len(values) > 1 else None)


def test_quotes_and_mixing():
    assert L.terms('"a,b;c",d').values == ("a,b;c", "d")
    assert L.terms("a,,b,").values == ("a", "b")
    for bad in ("a,b;c", '"a'):
        with pytest.raises(L.LanguageError):
            L.terms(bad)


@given(WORD, st.sampled_from(L.OPERATORS), st.integers(-99, 99))
def test_comparison(key, op, value):
    assert L.comparison(f"{key}{op}{value}") == L.Comparison(key, op, str(value))


def test_inherited_key_and_operator():
    found, by = L.comparisons("cadd>5,10,<2")
    assert found == [L.Comparison("cadd", ">", "5"), L.Comparison("cadd", ">", "10"), L.Comparison("cadd", "<", "2")] and by == L.OR


def test_scopes_and_keys():
    assert L.scoped("a:b:c") == ("a:b", "c") and L.scoped("c", "s") == ("s", "c")
    assert L.by_key("s1:0/1,1/1;s2:0/0") == ({"s1": ["0/1", "1/1"], "s2": ["0/0"]}, L.AND)
    assert L.same_sign(("!a", "!b")) and not L.same_sign(("a",))
    with pytest.raises(L.LanguageError):
        L.same_sign(("a", "!b"))


def test_grouped():
    c = L.Comparison
    assert L.grouped("12:dp>20,gq>=10;13:dp>5") == ([("12", [c("dp", ">", "20"), c("gq", ">=", "10")]), ("13", [c("dp", ">", "5")])], L.AND, L.OR)
    assert L.grouped("1:dp>30;gq<90") == ([("1", [c("dp", ">", "30"), c("gq", "<", "90")])], None, L.AND)
    assert L.grouped("a:x>1,b:x>2,a:y=3") == ([("a", [c("x", ">", "1"), c("y", "=", "3")]), ("b", [c("x", ">", "2")])], L.OR, L.OR)
    assert L.grouped('f:filter="a;b"') == ([("f", [c("filter", "=", "a;b")])], None, None)
    for bad in ("dp>3", "a:x>1,y>2;z>3", "a:x>1,b:x>2;c:x>3"):
        with pytest.raises(L.LanguageError):
            L.grouped(bad)


def test_terms_of():
    assert filters.terms_of("1583,SO:0001587,intron_variant") == ("missense_variant", "stop_gained", "intron_variant")
    assert filters.terms_of("lof") == filters.terms_of("loss_of_function") and len(filters.terms_of("protein_altering")) == 12
    assert not {"transcript_amplification", "initiator_codon_variant"} & set(filters.terms_of("pa"))
    for bad in ("SO:9999999", "no_such_variant", "12"):
        with pytest.raises(L.LanguageError):
            filters.terms_of(bad)


def test_genotypes():
    assert filters.genotypes("0/1,HOM_ALT") == (["0/1", "0|1", "1/0", "1|0"], [], ["HOM_ALT"], False)
    assert filters.genotypes("!0|1") == (["0|1"], [], [], True)
    literal, patterns, _, _ = filters.genotypes("1/2")
    hit = lambda g: g in literal or any(re.fullmatch(p, g) for p in patterns)
    assert all(map(hit, ("1/2", "2/1", "1|3", "12|1", "1/45"))) and not any(map(hit, ("1/1", "0/2", "2/2", "1/0", "1/20/3", "1/.")))


@pytest.mark.parametrize("params", [{"conservation": "banana>1"}, {"functionalScore": "sift>1"}, {"proteinSubstitution": "banana<0.1"}, {"populationFrequencyAlt": "x<0.1"}, {"sampleData": "1:banana>1"}, {"genotype": "1:FOO"}, {"sample": "7:deNovo"}, {"family": "nobody"}, {"source": "elsewhere"}, {"nonsense": "1"}, {"fileData": "f:filter<3"}, {"transcriptFlag": "fast"}])
def test_wrong_values_are_language_errors(spark, params):
    with pytest.raises(L.LanguageError):
        filters.condition(params)


def test_regions():
    assert L.region("chr1:10-20") == L.Region("1", 10, 20)
    assert L.region("MT") == L.Region("MT") and L.region("2:5-") == L.Region("2", 5, None) and L.region("2:5") == L.Region("2", 5, 5)
    assert L.merged([L.Region("1", 5, 9), L.Region("1", 10, 12), L.Region("1", 20, 30), L.Region("2", 1, 2)]) == [L.Region("1", 5, 12), L.Region("1", 20, 30), L.Region("2", 1, 2)]


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 9)), max_size=12))
def test_merged_regions_cover_the_same(pairs):
    regions = [L.Region("1", s, s + n) for s, n in pairs]
    cover = lambda rs: {p for r in rs for p in range(r.start, r.end + 1)}
    out = L.merged(regions)
    assert cover(out) == cover(regions)
    assert all(a.end + 1 < b.start for a, b in zip(out, out[1:]))


def test_facets():
    a, b = L.facets("chromosome[1,2]>>type:5;avg(cadd_scaled)")
    assert a == [L.Facet("chromosome", None, ("1", "2")), L.Facet("type", limit=5)] and b == [L.Facet("cadd_scaled", "avg")]
    (r,) = L.facets("popFreq[0..1]:0.1")[0]
    assert (r.low, r.high, r.step) == (0.0, 1.0, 0.1)
    with pytest.raises(L.LanguageError):
        L.facets("popFreq[0..1]")
