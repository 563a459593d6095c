import math
import re
from collections import Counter

from llm_cases import nasty, table

from noticemill.llm import licences
from noticemill.llm.queries import as_files

FILES = [
    ("1", "/a/LICENSE", "Licensed under the Apache License, Version 2.0.\nmore prose here"),
    ("2", "/a/b/c/x.py", "# code\nprint(1)"),
    ("3", "/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("4", "/a/b/c/y.py", "# Released under the MIT License.\nprint(2)"),
    ("5", "/a/z/q.py", None),
    ("6", "/other/q.py", "no words of the kind"),
    ("7", "/other/LICENSE", "a licence of our own making, which no template states in any way at all"),
    ("8", "/a/b/LICENSE.md", "Released under the MIT License."),
    ("9", None, "Licensed under CC BY-NC 4.0."),
    ("10", None, "nothing"),
    ("11", "top.py", "nothing"),
    ("12", "/a/b/c/d/e/f/deep.py", ""),
    ("12", "/a/b/c/d/e/f/deep.py", ""),
    ("13", "/ab/x.py", "prefix of a name is no ancestor"),
]


def terms(text):

    return Counter(t for t in re.split(r"[^a-z0-9.]+|\.+(?=[^a-z0-9]|$)", text.lower()) if t)


def brute(files):

    hint = re.compile(licences.HINT)
    name_of = re.compile(licences.LICENCE_FILE)
    notices = []
    for _, path, text in files:
        text = text or ""
        own = {x for x in text.split("\n") if hint.search(x)}
        if path is not None and name_of.search(path.split("/")[-1]) and hint.search(text):
            own.add(text)
        notices.append(own)
    count = Counter(x for own in notices for x in own)
    df = Counter()
    for x, n in count.items():
        for t in terms(x):
            df[t] += n
    for _, x in licences.TEMPLATES:
        for t in terms(x):
            df[t] += 1
    n = sum(count.values()) + len(licences.TEMPLATES)
    vector = lambda x: {t: k * (math.log((n + 1.0) / (df[t] + 0.5)) + 0.1) for t, k in terms(x).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    best = {}
    for x in count:
        v = vector(x)
        scored = []
        for k, (name, text) in enumerate(licences.TEMPLATES):
            t = vector(text)
            scored.append((round(sum(w * t.get(a, 0) for a, w in v.items()) / (norm(v) * norm(t)), 6), -k, name))
        best[x] = max(scored)
    own = []
    for notes in notices:
        hits = [(best[x][0], best[x][2]) for x in notes if best[x][0] >= licences.COSINE]
        own.append(max(hits) if hits else None)
    declared = {}
    for (_, path, _), hit in zip(files, own):
        if hit and path is not None and name_of.search(path.split("/")[-1]):
            folder = re.sub("/[^/]*$", "", path)
            declared[folder] = max(declared.get(folder, (-1.0, "", "")), (hit[0], path, hit[1]))
    out = []
    for (i, path, _), hit in zip(files, own):
        found = (None, "none", None)
        if hit:
            found = (hit[1], "own", path)
        elif path is not None:
            at = re.sub("/[^/]*$", "", path)
            parts = at.split("/")
            for k in range(len(parts), 0, -1):
                d = declared.get("/".join(parts[:k]))
                if d:
                    found = (d[2], "inherited", d[1])
                    break
        out.append((i, path, *found))
    return sorted(out, key=str)


def found(spark, files):
    frame = spark.createDataFrame([(*f, "x", 1) for f in files], "file_id string, path string, text string, licence string, depth int")
    return sorted(((r.file_id, r.path, r.licence, r.origin, r.declared_by) for r in licences.scan_licences(frame).collect()), key=str)


def test_licences_equal_brute_force(spark):
    assert found(spark, FILES) == brute(FILES)


def test_nearest_ancestor_and_own_notice_win(spark):
    by_id = {r[0]: r for r in found(spark, FILES)}
    assert by_id["4"][2:4] == ("MIT", "own")
    assert by_id["2"][3] == "inherited" and by_id["2"][4].startswith("/a/b/")
    assert by_id["5"][2:] == ("Apache-2.0", "inherited", "/a/LICENSE")
    assert by_id["6"][3] == by_id["7"][3] == by_id["13"][3] == "none"
    assert by_id["9"][2:4] == ("CC-BY-NC-4.0", "own")


def test_every_template_names_its_own_licence(spark):
    files = [(str(k), f"/t{k}/x", text) for k, (_, text) in enumerate(licences.TEMPLATES) if re.search(licences.HINT, text)]
    got = {r[0]: r[2] for r in found(spark, files)}
    assert got == {k: licences.TEMPLATES[int(k)][0] for k, *_ in files}


def test_documents_as_files_and_empty_table(spark):
    data = nasty()
    rows = licences.scan_licences(as_files(table(spark, data))).collect()
    assert len(rows) == len(data) and all(r.origin == "none" for r in rows)
    assert licences.scan_licences(as_files(table(spark, []))).collect() == []


def test_headers_of_several_lines_and_notices_inside_lines(spark):
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this",
           "file, You can obtain one at http://mozilla.org/MPL/2.0/."]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    prose = "the parser reads every table of the folder in turn and keeps a count of its rows for the report"
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        ("1", "/a/x.c", "/* " + "\n * ".join(mpl) + " */\nint main() {}"),
        ("2", "/b/x.py", "\n".join("# " + x for x in gpl) + "\nimport os"),
        ("3", "/c/x.md", f"{prose}. {apache} {prose}."),
        ("4", "/d/x.md", f"{prose} {apache} {prose}"),
        ("5", "/e/x.rs", "// This file of the project may be used as its\n// owner says: it is released under the\n// MIT License.\nfn main() {}"),
        ("6", "/f/LICENSE", "   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n"
         + "\n".join(f"clause {k} {prose}" for k in range(200))),
        ("7", "/g/x.md", f"{prose} with a licence nobody has {prose}"),
    ]
    got = {r[0]: r[2] for r in found(spark, files)}
    assert got == {"1": "MPL-2.0", "2": "GPL-3.0", "3": "Apache-2.0", "4": "Apache-2.0", "5": "MIT", "6": "Apache-2.0", "7": None}
