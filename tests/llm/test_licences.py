import re

import pytest

from revlens.llm import licences as L
from revlens.llm.licence_texts import SENTENCES

TABLE = L._table(SENTENCES)


def _licences(text):
    found = L.identify(text, TABLE, L._starts(TABLE))
    return [x for x, _, _ in L.match_rules([n for n, _, _ in found])]


@pytest.mark.parametrize("names, licence", [
    (("MitGrant", "MitNotice", "MitAsIs", "MitLiability"), ["MIT"]),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"), ["BSD-3-Clause"]),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"), ["BSD-2-Clause"]),
    (("ApacheHead", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"), ["Apache-2.0"]),
    (("Gpl2OrLater", "GplNoWarranty", "GplSee"), ["GPL-2.0-or-later"]),
    (("MitRef", "CcByNc4Ref"), ["MIT", "CC-BY-NC-4.0"]),
    (("MitGrant",), []),
    (("Lgpl21Terms", "LibraryNoWarranty", "LgplSee"), ["LGPL-2.1-or-later"]),
    (("Lgpl3Terms", "LibraryNoWarranty", "LgplSee"), ["LGPL-3.0-or-later"]),
    (("Agpl3Terms", "GplNoWarranty", "AgplSee"), ["AGPL-3.0-or-later"]),
    (("Epl2Notice", "ZlibGrant", "BoostNotice", "BoostSee"), ["EPL-2.0", "Zlib", "BSL-1.0"]),
    (("Spdx:BSD-3-Clause", "Spdx:MIT"), ["BSD-3-Clause", "MIT"]),
])
@pytest.mark.parametrize("wrap", [0, 40])
def test_rules(names, licence, wrap):
    text = "Some words before.\n" + "\n".join(SENTENCES[n] for n in names) + "\nand after"
    if wrap:
        text = re.sub(r"(.{%d}\S*) " % wrap, r"\1\n", text)
    assert _licences(text) == licence


def test_spans_unknown_sentences_and_edges(spark, small, none):
    text = "é prose |\nReleased under the MIT License.\nThis is licensed under the Foo License."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "prose only")],
                                 "doc_id long, text string")
    got = {r.id: r for r in L.scan(docs).collect()}
    (m,) = got[1].licences
    assert (m.licence, text[m.start:m.end]) == ("MIT", "Released under the MIT License.")
    assert got[1].sentences == ["MitRef", "UNKNOWN"]
    assert all(got[i].sentences == [] and got[i].licences == [] for i in (2, 3, 4))
    assert L.scan(small).count() == small.count() and L.scan(none).count() == 0


def test_lines_of_the_documents(spark, sf_dir):
    lines = {SENTENCES[n]: licence for licence, (n, *more) in L.RULES if n.endswith("Ref") and not more}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: [lines[x] for x in r.text.split("\n") if x in lines] for r in docs.collect()}
    got = {r.id: [m.licence for m in r.licences] for r in L.scan(docs).collect()}
    assert got == want and any(want.values())


@pytest.mark.parametrize("name", SENTENCES)
@pytest.mark.parametrize("width", [1, 10, 24, 30, 36, 38])
def test_sentences_wrapped_over_any_number_of_lines(name, width):
    lines, line = [], ""
    for word in SENTENCES[name].split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    text = "\n".join([*lines, line])
    assert re.search(L.TRIGGER, text)
    assert [x for x, _, _ in L.identify(text, TABLE, L._starts(TABLE))] == [name]


def test_a_whole_licence_in_a_narrow_column():
    names = ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")
    assert _licences("\n".join(" * " + w for n in names for w in SENTENCES[n].split())) == ["MIT"]


BSD = ("BsdGrant", "BsdSource", "BsdBinary")
ENDORSE = SENTENCES["BsdEndorse"]


@pytest.mark.parametrize("marks", [("1.", "2.", "3."), ("(a)", "(b)", "(c)"), ("*", "*", "*")])
@pytest.mark.parametrize("clause, licence", [
    ("", ["BSD-2-Clause"]),
    (ENDORSE, ["BSD-3-Clause"]),
    (ENDORSE.replace("the copyright holder", "Foo Inc. of Bar, Baz and Sons"), ["BSD-3-Clause"]),
    ("The name of the author may not be used to endorse or promote products derived from this "
     "software without specific prior written permission.", ["BSD-3-Clause"]),
    ("Neither the name of Foo may appear anywhere.", []),
    ("All advertising materials mentioning features or use of this software must display the "
     "following acknowledgement:", []),
    (ENDORSE.replace("the copyright holder", "x " * (L.SLOT_WORDS + 1)), []),
])
@pytest.mark.parametrize("disclaimer", ["", SENTENCES["BsdAsIs"]])
def test_a_stricter_text_is_not_the_plain_licence(marks, clause, licence, disclaimer):
    grant, *clauses = [SENTENCES[n] for n in BSD] + [clause] * bool(clause)
    text = "\n".join([grant, *map(" ".join, zip(marks, clauses)), disclaimer, "and after"])
    assert _licences(text) == licence


@pytest.mark.parametrize("text, licence", [
    ("Foo is free software: " + SENTENCES["Gpl3Terms"], ["GPL-3.0-or-later"]),
    ("Foo is free software; " + SENTENCES["Gpl2OnlyTerms"], ["GPL-2.0-only"]),
    ("// SPDX-License-Identifier: GPL-2.0-only\ncode", ["GPL-2.0-only"]),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode", []),
    ("# SPDX-License-Identifier: Foo-1.0\ncode", []),
])
def test_names_and_tag_lines(text, licence):
    assert _licences(text) == licence
    assert licence or L.identify(text, TABLE, L._starts(TABLE))[0][0] == L.UNKNOWN
