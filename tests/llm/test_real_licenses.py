"""Operator 2 on licence texts as they are found: wrapped, commented, with and without titles; and its registered query."""

import textwrap

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamline.llm import licenses
from seamline.llm.queries import queries

SMALL = "/root/testdata/sf0.01"
GPL = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the "
       "Free Software Foundation{1} either version {3} of the License, or (at your option) any later version.\n\nThis {0} is distributed in the hope "
       "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
PREAMBLE = ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\n"
            "The licenses for most software are designed to take away your freedom to share and change it.")
APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
          "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0")
BODY = dict(licenses.BODIES)


def wrapped(text, width=68, mark=""):
    return "\n".join(f"{mark}{line}" for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


CASES = [
    ("MIT", "Copyright (c) 2020 Jane Doe\n\n" + wrapped(BODY["MIT"])),
    ("MIT", wrapped("Copyright 2020 Jane Doe\n\n" + BODY["MIT"], 60, "// ") + "\npackage main\n\nfunc main() { run(1, 2, 3) }\n" * 40),
    ("BSD-2-Clause", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + wrapped(BODY["BSD-2-Clause"])),
    ("BSD-3-Clause", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n" + wrapped(BODY["BSD-3-Clause"])),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n" + wrapped(PREAMBLE)),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + wrapped(PREAMBLE)),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + wrapped(PREAMBLE)),
    ("AGPL-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n" + wrapped(PREAMBLE)),
    ("GPL-2.0", wrapped(GPL.format("program", ";", "", "2"), 60, " * ")),
    ("GPL-3.0", wrapped(GPL.format("program", ":", "", "3"), 60, "# ")),
    ("LGPL-2.1", wrapped(GPL.format("library", ";", "Lesser ", "2.1"))),
    ("LGPL-3.0", wrapped(GPL.format("library", ":", "Lesser ", "3"))),
    ("AGPL-3.0", wrapped(GPL.format("program", ":", "Affero ", "3"))),
    ("Apache-2.0", wrapped(APACHE, 60, "// ")),
    (None, "the program is free and you can use it at any time.\nit is under the table, as it was before"),
    (None, "General terms and conditions of the public library apply to any later version of this text"),
]


@pytest.fixture(scope="module")
def prose(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), "text")


def test_wrapped_licences_are_rightly_named(spark, prose):
    cases = spark.createDataFrame([(f"cases/{i}", t) for i, (_, t) in enumerate(CASES)], "path string, text string")
    model = licenses.fit(prose.unionByName(cases))
    found = {r.path: r.own_license for r in licenses.scan(cases, model).collect()}
    assert [found[f"cases/{i}"] for i in range(len(CASES))] == [name for name, _ in CASES]


def test_bound_loses_no_licence(spark, prose):
    model = licenses.fit(prose)
    everything = licenses.model_of({}, 0)
    assert everything.vectors.shape[1] == len(licenses.vocabulary())
    plain = {r.path: (r.own_license, round(r.own_score, 9)) for r in licenses.scan(prose, model).collect() if r.own_license}
    old = licenses._best

    def unbounded(model, unit, hashes, templates, threshold):
        return old(model, unit, hashes, templates, 0.0)

    rows = prose.collect()
    run = licenses._scanner(type("B", (), {"value": model}), None)
    batch = pa.record_batch([pa.array([r.path for r in rows]), pa.array([r.text for r in rows])], names=["path", "text"])
    licenses._best = unbounded
    try:
        full = pd.concat([b.to_pandas() for b in run([batch])])
    finally:
        licenses._best = old
    full = full[full.own_license.notna()]
    assert plain == {p: (n, round(s, 9)) for p, n, s in zip(full.path, full.own_license, full.own_score)}


def test_registered_query_keeps_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries()["op2_license_scan"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.path.rpartition("/")[2].removeprefix("LICENSE.") == str(r.doc_id) for r in rows)
    assert any(r.own_license for r in rows) and all(r.license_path == r.path for r in rows if r.own_license)


def test_ids_of_any_size_are_carried_and_inherit(spark, tmp_path):
    ids = [-50, 10**18 + 7, 9_223_372_036_854_775_807, None, 500]
    licence = "Released under the MIT License."
    spark.createDataFrame([*((i, licence, "en", "web") for i in ids), (501, "nothing", "en", "web"), (501, "nothing", "de", "web")],
                          "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["op2_license_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted([*ids, 501, 501], key=str)
    assert {(r.path, r.license, r.license_path) for r in rows if r.doc_id == 501} == {
        ("web/en/10/501", "MIT", "web/en/LICENSE.500"), ("web/de/10/501", None, None)}
