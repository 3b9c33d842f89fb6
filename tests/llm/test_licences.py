from polarity.llm.licence_texts import LICENCES
from polarity.llm.licences import scan_licences


def test_scan(spark, edge_docs, no_docs):
    texts = dict(LICENCES[::-1])
    mit = [t for i, t in LICENCES if i == "MIT"][0]
    rows = [(1, mit), (2, mit.upper().replace(",", " ;")), (3, "Copyright (c) 2020 A. Person\n\n" + mit), (4, mit.replace("sublicense", "sub-license")), (5, mit + " extra"),
            (6, "Text.\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0.\nreleased under the mit license."), (7, None), (8, ""), (9, "(c) 2020 only"),
            (10, texts["Zlib"].replace("acknowledgment", "acknowledgement")), (None, texts["ISC"]), (6, "nothing"), (1, mit)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, license_id string")
    got = sorted((tuple(r) for r in scan_licences(df).collect()), key=str)
    want = [(1, "MIT", 0, []), (1, "MIT", 0, []), (2, "MIT", 0, []), (3, "MIT", 0, []), (4, "MIT", 0, []), (5, None, 0, []), (6, None, 3, ["CC-BY-NC-4.0", "MIT"]), (6, None, 0, []),
            (7, None, 0, []), (8, None, 0, []), (9, None, 0, []), (10, "Zlib", 0, []), (None, "ISC", 0, [])]
    assert got == sorted(want, key=str)
    assert scan_licences(no_docs).collect() == [] and scan_licences(edge_docs).count() == edge_docs.count()


def test_known_texts_differ_by_licence(spark):
    from polarity.llm.licences import known_licences
    assert known_licences(spark).count() >= len({i for i, _ in LICENCES})
    assert known_licences(spark).filter("license_id = 'MIT'").count() == len([1 for i, _ in LICENCES if i == "MIT"])


def test_whole_texts_of_long_licences(spark):
    from polarity.llm.licence_texts import _DIR, _FILES
    assert {f.stem for f in _DIR.iterdir()} == set(_FILES)
    rows = [(i, (_DIR / f"{name}.txt").read_text(encoding="utf-8")) for i, name in enumerate(_FILES)]
    got = {r["doc_id"]: r["license_id"] for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == list(_FILES.values())


def test_only_notices_are_dropped(spark):
    import textwrap
    texts = dict(LICENCES[::-1])
    mit = [t for i, t in LICENCES if i == "MIT"][0]
    bsd = texts["BSD-3-Clause"]
    rows = [(1, "\n".join(textwrap.wrap(mit, w))) for w in range(40, 100)] + [(2, "\n".join(textwrap.wrap(bsd, w))) for w in range(40, 100)]
    rows += [(2, "Copyright 2020 The Foo Authors. All rights reserved. " + bsd), (2, "(c) 2020 Foo Inc. All rights reserved.\n" + bsd), (2, "Copyright by Foo Limited. " + bsd),
             (3, "Copyright law holds for " + bsd), (3, "(c) You must retain " + bsd)]
    got = {(r["doc_id"], r["license_id"]) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "BSD-3-Clause"), (3, None)}
