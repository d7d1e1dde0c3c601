"""Licence scan against SQL and hand-made cases."""

import textwrap

from compare import database, differences

from weftbook.llm import licences
from weftbook.llm.queries import ORACLE, QUERIES


def test_whole_table(spark, sf_dir):
    assert differences(QUERIES["op7_licence_scan"](spark, sf_dir), database(sf_dir), ORACLE["op7_licence_scan"]) == []


def test_hand_made(spark):
    full = max(licences.TEMPLATES, key=lambda t: len(t[1]))
    docs = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "licensed UNDER the apache license version 2 0"),
        (3, "prose here\nReleased under the MIT License.\nmore of it"), (4, None), (5, ""), (6, "one"), (7, "word " * 20000),
        (8, full[1]), (9, "Permission is hereby granted, free of charge, to any person"), (None, "Licensed under CC BY-NC 4.0."),
        (10, full[1].replace(" ", "\n")), (11, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0."),
        (12, "This work is licensed under the GNU Public License, version 3."),
    ]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, licence string, unit int")
    found = {r.doc_id: (r.licence, r.dice, r.unit, r.n_matches) for r in licences.scan(frame).collect()}
    assert len(found) == len(docs)
    assert found[1] == found[2] == ("Apache-2.0", 1.0, 0, 1)
    assert found[3] == ("MIT", 1.0, 1, 1)
    assert found[4] == found[5] == found[6] == found[7] == found[9] == (None, None, None, 0)
    assert found[8] == ("MIT", 1.0, 0, 1) and found[10] == ("MIT", 1.0, licences.WHOLE, 1)
    assert found[None] == ("CC-BY-NC-4.0", 1.0, 0, 1)
    assert found[11] == ("CC-BY-4.0", 1.0, 0, 2)
    assert found[12][0] == "GPL-3.0" and 0.8 <= found[12][1] < 1


def test_notices_over_lines_and_within_lines(spark):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    gpl = next(t for n, t in licences.TEMPLATES if n == "GPL-3.0" and "free software" in t)
    apache = next(t for n, t in licences.TEMPLATES if n == "Apache-2.0" and len(t) > 100)
    wrapped = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 75))
    prose = "and " + " ".join(f"of the {i} words to use" for i in range(400))
    warranty = (
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE '
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )
    docs = [
        (1, f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrapped(mit)}\n\n{wrapped(warranty)}"),
        (2, f"/*\n * some.c\n{wrapped(gpl, ' * ')}\n */\n{wrapped(prose)}"),
        (3, f"#!/bin/sh\n{wrapped(apache.replace('Licensed under', 'It is made available under'), '# ')}\n{wrapped(prose)}"),
        (4, f"{prose} Released under the MIT License. {prose} Licensed under CC BY-NC 4.0. {prose}"),
        (5, f"{prose} {mit} {mit} {prose}"), (6, prose), (7, " ".join(reversed(mit.split())) + "\n" + prose),
        (8, f"x\n{prose} released under the MIT license\nReleased under the MIT License.\nmore"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: (r.licence, r.dice, r.unit, r.n_matches) for r in licences.scan(frame).collect()}
    assert found[1] == ("MIT", 1.0, 4, 1)
    assert found[2] == ("GPL-3.0", 1.0, 2, 1)
    assert found[3][0] == "Apache-2.0" and found[3][1] > 0.9
    assert found[4] == ("CC-BY-NC-4.0", 1.0, 0, 2)
    assert found[5] == ("MIT", 1.0, 0, 2)
    assert found[6] == found[7] == (None, None, None, 0)
    assert found[8] == ("MIT", 1.0, 1, 2)


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = QUERIES["op7_licence_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
