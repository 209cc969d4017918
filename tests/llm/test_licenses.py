import re

from helpers import EDGE, frame, prose

from gridloom.llm import licenses

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = W.findall((text or "").translate(LOWER))
    at = [(i, v) for i in range(len(w)) for k, v in licenses.BASE.items() if w[i : i + len(k.split())] == k.split()]
    i = [x for x, _ in at]
    return len(w), len(at), min(i, default=None), max(i, default=None), ",".join(sorted({v for _, v in at}))


ROWS = EDGE + [
    (20, "Released under the MIT License. Also under the MIT license; CC BY-NC, cc_by_nc"),
    (21, "Licensed under the Apache License, Version 2.0. " + prose(5, 30)),
    (22, "ÀLicensed under the terms of the GNU General Public License, version 3, or (at your option) any later version"),
    (23, "licensed under the gnu general public licence version 3"),
    (24, "under the mit under the mit license"),
    (25, "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine piece and associated documentation files (the Work) to deal in the Work without restriction"),
    (26, "Licensed under the GNU General Public License, version 3"),
]


def test_base_matches_brute_force(spark, sf):
    got = sorted(str(tuple(r)[:6]) for r in licenses.scan(frame(spark, ROWS, extra=True)).collect())
    assert got == sorted(str((d, *brute(t))) for d, t, *_ in ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_templates_need_exact_mandatory_words(spark):
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(spark, ROWS[len(EDGE) :])).collect()}
    assert got[20][0] == "cc-by-nc,mit,mit-notice" and got[21][0] == "apache-2,apache-2.0-notice"
    assert got[22] == ("", 0.0) and got[23] == ("", 0.0)  # another first word; a misspelt mandatory word
    assert got[26] == ("gpl-3-notice", 1.0)
    assert got[25][0] == "mit-grant" and 0.7 < got[25][1] < 1
    assert licenses.scan(frame(spark, ROWS).limit(0)).count() == 0


def test_automaton_regions():
    m = licenses.Automaton({"x": ["a <<opt>> b <<opt>> c <<end>> <<end>> <<var 1-2>> d"]})
    hit = lambda s: [x[0] for x in m.matches(s.encode().split(), 0)]
    assert all(hit(s) for s in ("a q d", "a b q d", "a b c q q d", "a q q d", "a d d"))
    assert not any(hit(s) for s in ("a d", "a q q q d", "b q d", "a b q q q d"))
