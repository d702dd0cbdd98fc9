"""Candidates by form, evidence by context, and redaction."""

import pytest

from strandframe.llm import personal

GIVEN = frozenset(["Ada", "Max", "Ruby", "Mark", "Will"])


def kinds(line):
    return [(line[a:b], k) for a, b, k, *_ in personal.candidates(line, GIVEN)]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("// cc a.b at mail dot x dot example and c+d@y.test", [("a.b at mail dot x dot example", "email"), ("c+d@y.test", "email")]),
        ("mailto:q%40z.example, w&#64;z.example w [at] z[dot]example", [("q%40z.example", "email"), ("w&#64;z.example", "email"), ("w [at] z[dot]example", "email")]),
        ("clone git@git.example.org:tools/store.git needs tile-rank@4.15.9 remote ssh://git@x.invalid/p.git ACGT@60%", []),
        ("tel:+44 (0)20 7946 0655 or (030) 23125-248", [("+44 (0)20 7946 0655", "phone"), ("(030) 23125-248", "phone")]),
        ("+1-819‑555‑0109;01.99.00.16.08;030/23125389", [("+1-819‑555‑0109", "phone"), ("01.99.00.16.08", "phone"), ("030/23125389", "phone")]),
        ("uuid 00000000-0498-4330-8190-885737386352 matches 0x80109af3 epoch 1603372688 version 4.15.0-7558", []),
        ("build 20190465-417790 ticket 0758-92-957 array[19] = 581.576.67 range 67-48-52 listens on 192.0.2.98:8003", []),
        ('ROW = "x\\tQQ 12 34 56 C|\\t934-23-7691"', [("QQ 12 34 56 C", "id_number"), ("934-23-7691", "id_number")]),
        ("passport Z006249613, IdNr. 04 016 003 782, DNI 00251444-T", [("Z006249613", "id_number"), ("04 016 003 782", "id_number"), ("00251444-T", "id_number")]),
        ("ship to Flat 7, 58 Elms Rd, Kolvik or PO Box 0783 or 602 bis, rue de la Brume, 00049 X", [("Flat 7, 58 Elms Rd", "address"), ("PO Box 0783", "address"), ("602 bis, rue de la Brume", "address")]),
        ("Hinter den Höfen 232, 00516 H; Kolvikstr. 62", [("Hinter den Höfen 232", "address"), ("Kolvikstr. 62", "address")]),
        ("(c) 2012-2019 Pearl Lane Collective; The Brindle Authors; 4 way merge, 12 lane input", []),
        ("'Ada  van Holt-Berg' and Holt, Ada and A. Holt's", [("Ada  van Holt-Berg", "name"), ("Holt, Ada", "name"), ("A. Holt", "name")]),
        ("担当：西園 拓海", [("西園 拓海", "name")]),
        ("signed by Ada Maria Luisa de la Cruz Garcia Lopez", [("Ada Maria Luisa de la Cruz Garcia Lopez", "name")]),
        ("The Ada Cruz file; Passport Max Cruz, National Insurance Number", [("Ada Cruz", "name"), ("Max Cruz", "name")]),
        ("One Two Three Four Five Six Seven Eight Nine Ada Cruz Max Berg x", [("One Two Three Four Five Six Seven Eight", "name"), ("Ada Cruz", "name"), ("Max Berg", "name")]),
        ("", []),
    ],
)
def test_candidates(line, want):
    assert kinds(line) == want


def test_terms():
    """What stands beside a name is known by kind, not by its words."""
    line = "| Ada Holt | ada.holt@mail.example | +44 20 7946 0655 |"
    (name,) = [t for *_, k, _, t in personal.candidates(line, GIVEN) if k == "name"]
    assert "R2 | " + personal.SIGNS["email"] in name and "G Ada" in name and "S Holt" in name
    assert all(any(x.startswith("F ") for x in t) for *_, k, sure, t in personal.candidates(line, GIVEN) if k != "name" and sure)


def corpus():
    families = ["Holt", "Berg", "Dahl", "Roth", "Lund", "Voss"]
    rows = []
    for i, f in enumerate(families):
        rows.append((i, f"﻿// reviewed by Ada {f}\n# Max {f} wrote this\nfax 0049 30 2312590{i}\nSSN {900 + i}-12-3456\n"))
    rows.append((50, "// reviewed by Unlisted Holt\ncode\n// Ruby Bindings are stale\n// Max Depth reached, Will Retry set\nthe Mark Sweep pass runs first"))
    rows += [(60, None), (61, ""), (62, "  \n"), (63, "x" * 300000), (50, rows[-1][1])]
    return rows


def test_find_and_redact(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as kind", "1 as start", "2 as version")
    got = personal.find_personal(df, "doc_id", "text", GIVEN).collect()
    texts = dict(rows)
    cut = {(r["doc_id"], texts[r["doc_id"]][r["start_pos"] :].split("\n")[0], r["kind"]) for r in got}
    assert {x for x in cut if x[0] == 50} == {(50, "Unlisted Holt", "name")}
    assert {x[1:] for x in cut if x[0] == 3} == {("Ada Roth", "name"), ("Max Roth wrote this", "name"), ("0049 30 23125903", "phone"), ("903-12-3456", "id_number")}
    assert len(got) == len(set(got)) and not {60, 61, 62, 63} & {r["doc_id"] for r in got}
    clean = personal.redact(df, "doc_id", "text", GIVEN).collect()
    assert len(clean) == len(rows)
    out = {r["doc_id"]: r["text"] for r in clean}
    assert out[3] == "﻿// reviewed by [NAME]\n# [NAME] wrote this\nfax [PHONE]\nSSN [ID_NUMBER]\n"
    assert out[60] is None and out[61] == "" and out[63] == "x" * 300000
    assert "Ruby Bindings" in out[50] and "[NAME]" in out[50]
    assert personal.find_personal(df.limit(0), "doc_id", "text", GIVEN).count() == 0
