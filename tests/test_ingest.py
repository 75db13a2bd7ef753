import os
import tempfile

from entlink.operators import triples as TR
from entlink.sources import rdf

LINES = [
    b'<http://a/x> <http://p/label> "caf\xc3\xa9"@en .',
    b'<http://a/y> <http://p/label> "caf\xe9 latin"@en .',
    b"# completed",
    b"",
    b'<http://a/y> <http://p/size> "1"^^<http://t/int> .',
    b"<http://a/y> <http://p/knows> <http://a/x> .",
    b'<http://a/z> <http://p/label> "bonjour"@fr .',
    b'<http://a/z> <http://p/label> "hi \\"q\\" | > x"@en-GB .',
    b'<http://a/w> <http://p/mail> "me@example.org" .',
    b"not a triple",
]


def _write(lines, name):
    d = tempfile.mkdtemp(prefix="entlink-test-", dir="/tmp")
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(b"\n".join(lines) + b"\n")
    return p


def test_parse_and_latin1_fallback(spark):
    p = _write(LINES, "dump.nt")
    t = rdf.read_ntriples(spark, p, lang=None)
    assert t.count() == 7
    rows = {(r.s, r.p): r for r in t.collect()}
    assert rows[("http://a/x", "http://p/label")].o_lit == "café"
    assert rows[("http://a/y", "http://p/label")].o_lit == "café latin"
    typed = rows[("http://a/y", "http://p/size")]
    assert typed.dtype == "http://t/int" and typed.lang is None and typed.o_lit == "1"
    assert rows[("http://a/y", "http://p/knows")].o_iri == "http://a/x"
    assert rows[("http://a/z", "http://p/label")] is not None


def test_lang_gates(spark):
    p = _write(LINES, "dump.nt")
    gated = rdf.read_ntriples(spark, p, lang="en")
    langs = sorted({r.lang for r in gated.collect()}, key=str)
    assert langs == ["None", "en", "en-GB"] or langs == [None, "en", "en-GB"]
    strict = rdf.read_ntriples(spark, p, lang="en", strict=True)
    s_objs = {r.o_lit for r in strict.collect()}
    assert "me@example.org" not in s_objs and "bonjour" not in s_objs
    lits = TR.literals(gated)
    assert {r.o for r in lits.collect()} == {"café", "café latin"}   # '@en-GB' is not English here


def test_disambiguation_by_file_name(spark):
    p1 = _write([b"<http://a/P> <http://p/d> <http://a/x> ."], "pages_disambiguation_en.nt")
    p2 = _write([b"<http://a/Q> <http://p/d> <http://a/y> ."], "other.nt")
    t = rdf.read_ntriples(spark, [p1, p2], lang=None)
    assert [(r.s, r.o) for r in rdf.read_disambiguation(t).collect()] == [("http://a/P", "http://a/x")]


def test_bz2_is_read(spark):
    import bz2
    d = tempfile.mkdtemp(prefix="entlink-test-", dir="/tmp")
    p = os.path.join(d, "d.nt.bz2")
    with open(p, "wb") as f:
        f.write(bz2.compress(b"\n".join(LINES[:2]) + b"\n"))
    assert rdf.read_ntriples(spark, p, lang=None).count() == 2


def test_control_characters_do_not_lose_lines(spark):
    p = _write([b'<http://a/x> <http://p/l> "one\x01two"@en .', b'<http://a/y> <http://p/l> "caf\xe9\x01"@en .'], "ctl.nt")
    assert {r.o_lit for r in rdf.read_ntriples(spark, p, lang=None).collect()} == {"one\x01two", "café\x01"}


def test_angle_brackets_inside_an_iri(spark):
    p = _write([b"<http://a/x<y> <http://p/l> <http://a/z> ."], "odd.nt")
    assert [(r.s, r.p, r.o_iri) for r in rdf.read_ntriples(spark, p, lang=None).collect()] == [("http://a/x<y", "http://p/l", "http://a/z")]
