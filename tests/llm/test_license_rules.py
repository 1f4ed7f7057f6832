from pyspark.sql import functions as F

from tessera.llm.license_scan import PHRASES, TEMPLATES, Index, Template, license_digest, scan_licenses, scan_words
from tessera.llm.quality_rules import judge

TEXTS = [
    (1, "Released under the MIT License."),
    (2, "x under the mit\nlicense, and UNDER THE MIT LICENSE! apache license version 2 cc-by-nc"),
    (3, None),
    (4, ""),
    (5, "This work is licensed under the GNU General Public License, version 3."),
    (6, "GNU General Public thing, licence version 3"),
    (7, "word " * 30000 + "cc by nc"),
    (7, "word " * 30000 + "cc by nc"),
    (None, "under the mit license"),
    (8, "thé under the mit licenseé"),
]


def naive(text):
    words, w = [], ""
    for ch in (text or "").translate({i: i + 32 for i in range(65, 91)}) + " ":
        if "0" <= ch <= "9" or "a" <= ch <= "z" or ch >= "\x80":
            w += ch
        elif w:
            words.append(w)
            w = ""
    places = [(i, p.label) for p in PHRASES for i in range(len(words)) if words[i : i + len(p.text.split())] == p.text.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan_against_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("labels", F.lit(1))
    rows = license_digest(scan_licenses(docs)).collect()
    assert len(rows) == len(TEXTS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == sorted((i is None, i or 0, *naive(t)) for i, t in TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[5].labels == "gpl-3" and by[5].base_labels == "" and 0 < by[5].score <= 1
    assert by[6].labels == "" and by[6].score == 0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert license_digest(scan_licenses(docs.limit(0))).collect() == []


def naive_notices(index, text):
    """Every template held against every start."""
    words, found = scan_words(text), []
    for k, template in enumerate(index.words):
        for start in range(-len(template), len(words)):
            at = [p for p in range(len(template)) if 0 <= start + p < len(words) and words[start + p] == template[p]]
            if len(at) < min(index.least_aligned, len(template)) or any(not set(range(p, p + len(m))) <= set(at) for p, m in index.mandatory[k]):
                continue
            cover = sum(index.idf[template[p]] for p in at) / sum(index.idf[w] for w in template)
            if cover >= index.least_cover:
                found.append((k, max(0, start), round(min(1.0, cover), 9)))
    return sorted(found)


def test_no_licence_hides_another():
    """Files that state two licences, or hold many rare licence words besides, against every template at every start."""
    free = Template("free", "anyone may do anything with it", ())
    rare = " ".join(sorted({w for t in TEMPLATES for w in t.text.split()}))
    for templates, keep in ((TEMPLATES, 8), ((*TEMPLATES, free), 8), (TEMPLATES, 1)):
        index = Index(templates, PHRASES, keep, 2, 0.6)
        index.rarities(1000, {w: 1 + 37 * n % 500 for n, w in enumerate(sorted(index.vocabulary))})
        texts = [f"x {a.text} y {b.text} z" for a in templates for b in templates] + [f"{rare} {t.text}" for t in templates] + [" ".join(t.text.split()[1:]) for t in templates]
        for text in texts:
            found = [(k, i, round(c, 9)) for k, i, c in index.scan(text.encode())[2]]
            assert found == naive_notices(index, text.encode()), text
        for a in templates:
            for b in templates:
                labels = {templates[k].label for k, _, _ in index.scan(f"x {a.text} y {b.text} z".encode())[2]}
                assert {a.label, b.label} <= labels


def naive_rules(text):
    import re

    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    seen, n = {}, 0
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_rules_against_brute_force(spark):
    texts = [None, "", " \n\t", "a b c a b c", "the " * 60, "é|è# <x>\nfoo\nfoo\n\n \nfoo", "one two\x0bthree\x0cfour\r\n" * 40, " ".join(f"w{i}" for i in range(80)), " ".join(f"and w{i}" for i in range(9000)) + " x y z x y z", "a b a b a b", "a b c"]
    docs = spark.createDataFrame([(i, t, True, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, n_words string")
    out, m = judge(docs)
    assert {"kept", "n_words"} <= set(out.columns) and m["kept"] == "kept_"
    for r in out.collect():
        assert (r[m["n_words"]], r[m["word_chars"]], r[m["n_symbols"]], r[m["n_dup_lines"]], r[m["n_repeat_words"]], r[m["base_failed"]]) == naive_rules(texts[r.doc_id]), texts[r.doc_id]
        assert not (r[m["base_failed"]] and r[m["kept"]])
    assert judge(docs.limit(0))[0].count() == 0
