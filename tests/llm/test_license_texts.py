from importlib.resources import files

from larkspur.llm import licenses


def test_full_texts_and_common_dresses(spark, docs):
    full = {f.name[:-4]: f.read_text() for f in files("larkspur.llm").joinpath("license_texts").iterdir()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(full)
    mit = licenses.KNOWN["MIT"][1]
    cases = [(name, text) for name, text in sorted(full.items())]
    cases += [("Apache-2.0", full["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0", " ".join(full["GPL-3.0"].split("END OF TERMS")[0].split("\n   ")))]
    cases += [("MIT", mit.replace('"AS IS"', "“AS IS”")), ("MIT", f"The MIT License (MIT)\n\nCopyright Joyent, Inc. and other Node contributors.\n\n{mit}")]
    cases += [("MIT", f"Copyright Joyent, Inc. and other Node contributors.\r\n\r\n{mit}"), (None, f"some words {mit}"), (None, "Licensed – not")]
    got = {r.doc_id: r.license for r in licenses.scan(docs([(i, t, "en", "s") for i, (_, t) in enumerate(cases)])).collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}
