import random
import re
from collections import Counter

import pytest

from polyspec.llm import license_scan, line_dedup, quality_rules, url_filter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    words = [w for w in SPACE.split(t) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if any(SPACE.split(x))]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_brute_force(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a ", "b ", "c\n", "dé ", "#\t", "\x0b", "e e e "]) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts += [None, "", " ", "\n\n", "a b c a b c a b", "x " * 20000, "same line\nsame line\n same line", "a718116 b c a1625737 b c a718116 b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.base_counts(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t


def test_rules_are_ranked_on_what_reaches_them(spark, monkeypatch):
    # Only texts that pass the base test count, and of what an earlier rule rejects nothing is left to a later one.
    clean = " ".join(f"word{i} and" for i in range(60))
    texts = [clean.replace(" ", "!! ")] * 30 + [clean.upper()] * 10 + [clean] * 20 + ["#"] * 200
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = (quality_rules.Rule("symbols", "4 * n_symbols > n_words"), quality_rules.Rule("both", "{t} like '%!!%' OR {t} like '%WORD%'"), quality_rules.Rule("marks", "{t} like '%!!%'"), quality_rules.Rule("loud", "{t} like '%WORD%'"))
    monkeypatch.setattr(quality_rules.time, "perf_counter", iter(range(100)).__next__)  # equal costs
    assert [r.name for r in quality_rules.rule_order(df, "text", rules)] == ["both", "symbols", "marks", "loud"]
    assert quality_rules.rule_order(df.limit(0), "text", rules) == list(rules)


def test_cascade_verdicts_do_not_depend_on_order(spark):
    clean = " ".join(f"word{i} and" for i in range(60))
    texts = [clean, clean.upper(), clean.replace(" ", "### "), clean.replace(" ", "!! "), "short", None, "go on " * 80, clean]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, __text string, n_words int")
    want = [True, False, False, False, False, False, False, True]
    for rules in (None, quality_rules.RULES, tuple(reversed(quality_rules.RULES))):
        got = {r.doc_id: r for r in quality_rules.cascade(df, rules=rules).collect()}
        assert [got[i].kept for i in range(8)] == want
        assert got[0]["__text"] == "x"
    assert quality_rules.cascade(df.limit(0)).count() == 0
    # A filter on the verdict must not repeat the counts inside its predicate: that would take hours here.
    long = spark.createDataFrame([(1, clean + " word".join(map(str, range(30000))))], "doc_id long, text string")
    assert quality_rules.cascade(long, rules=quality_rules.RULES).where("kept").count() == 0  # mostly digits


def test_urls(spark):
    urls = {
        "http://A.example.COM/en/76?x": ("a.example.com", "/en/76", "example.com/en/7", "allow"),
        "https://shop.com/en/": ("shop.com", "/en/", "com/en/", "block"),
        "https://shop.com/en": ("shop.com", "/en", None, "allow"),
        "https://xexample.net/de/8": ("xexample.net", "/de/8", "net/de/", "allow"),
        "https://example.net/de/81#a": ("example.net", "/de/81", "example.net/de/8", "block"),
        "ftp://org/es/": ("org", "/es/", "org/es/", "block"),
        "com/en/": ("", "", None, "allow"),
        "http://com?/en/": ("com", "", None, "allow"),
        "a\nb://net/de/\n": ("net", "/de/\n", "net/de/", "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(i, u, "e") for i, u in enumerate([*urls, None, next(iter(urls))])]
    df = spark.createDataFrame(rows, "page_id long, url string, expr string")
    for limit in (100_000, 1, 0):
        got = {r.page_id: r for r in url_filter.judge(df, url_filter.rule_table(spark), broadcast_rules=limit).collect()}
        assert len(got) == len(rows)
        for i, u, _ in rows:
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == urls.get(u, ("", "", None, "allow")), u
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0
    assert url_filter.judge(df, url_filter.rule_table(spark, [("block", "a", "/")]).limit(0)).where("verdict = 'allow'").count() == len(rows)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_boilerplate_lines(spark, limit):
    pages = [(i, "h", f"own {i}\nfooter here\n\nfooter here ") for i in range(20)] + [(i, "h", f"own {i}") for i in range(20, 60)]
    pages += [(100 + i, "other", "footer here") for i in range(4)] + [(200, None, "footer here\nfine"), (201, "h", None), (202, "h", ""), (0, "h", pages[0][2])]
    pages += [(300 + i, "three", f"own {i}\n" + ("two of three" if i else "x" * 100_000)) for i in range(3)]
    df = spark.createDataFrame([(*p, "f") for p in pages], "doc_id long, source string, text string, digest string")
    got = line_dedup.drop_lines(df, broadcast_lines=limit).collect()
    assert len(got) == len(pages)
    by = {r.doc_id: r for r in got}
    assert by[3].text == "own 3\n" and (by[3].n_lines, by[3].n_dropped) == (4, 2)
    # On a host of four pages a line on all of them goes; on one page, or on two of three, none does.
    assert by[30].text == "own 30" and by[100].text == "" and by[100].n_dropped == 1 and by[200].text == "footer here\nfine"
    assert all(by[i].n_dropped == 0 and by[i].text == pages[-3 + i - 300][2] for i in (300, 301, 302))
    assert by[201].text == "" and by[201].n_lines == 0 and by[202].n_lines == 0
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)) if w]


def met_licenses(words, templates):
    met = {}
    for label, notice, must in templates:
        notice = license_words(notice)
        size, need = len(notice) + -(-len(notice) // 4), set(notice)
        for i in range(len(words)):
            block = set(words[i : i + size])
            if len(need & block) * 100 >= 80 * len(need) and set(must.split()) <= block:
                met[label] = max(met.get(label, 0), len(need & block) / len(need))
    return met


@pytest.mark.parametrize("limit", [100_000, 0])
def test_licenses_against_brute_force(spark, limit):
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    rnd = random.Random(4)
    texts = [None, "", "x\n" + notices[0], "CC-BY cc by CC BY", "MIT License mit license", "the gnu general public licenses", "GNU\nGeneral public License", "Released under MIT License", "KMIT License", "cc by"]
    texts += ["Licensed under CC BY-NC 4.0.", "Released under the Apache License.", "word " * 30000 + notices[8] + " word" * 30000]
    for _ in range(150):
        words = re.findall(r"\w+", rnd.choice(notices))
        kept = [w for w in words if rnd.random() < 0.85] + ["noise"] * rnd.randint(0, 3)
        if rnd.random() < 0.5:
            rnd.shuffle(kept)
        texts.append("intro line\n" * rnd.randint(0, 2) + "".join(w + rnd.choice(" \n") for w in kept) + "end of it" * rnd.randint(0, 1))
    texts += texts[-5:]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, __words string")
    got = {r.doc_id: r for r in license_scan.scan(df, broadcast_tokens=limit, broadcast_texts=limit).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = license_words(t)
        places = [(k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        met = met_licenses(words, license_scan.TEMPLATES)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), t
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and r.labels == ",".join(sorted({p[1] for p in places} | set(met))), t
        assert r.score == pytest.approx(1.0 if places else max(met.values(), default=0.0))
    assert license_scan.scan(df.limit(0)).count() == 0


def test_wrapped_notices_and_near_ones(spark):
    bsd, mit = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[8][1]
    wrap = lambda t: re.sub(r"((?:\S+ ){9})", "\\1\n * ", t)
    texts = [wrap(bsd), wrap(mit), "Licensed under CC BY-NC 4.0.", "Released under the Apache License."]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "mit", 2: "cc-by,cc-by-nc", 3: "apache"}


def test_many_templates(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    templates = tuple((f"t{k}", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 30))), "") for k in range(500))
    texts = []
    for _ in range(60):
        notice = rnd.choice(templates)[1].split()
        kept = [w if rnd.random() < 0.9 else "other" for w in notice]
        texts.append(" ".join([*rnd.choices(vocabulary, k=20), *kept, *rnd.choices(vocabulary, k=20)]))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()}
    for i, t in enumerate(texts):
        met = met_licenses(license_words(t), templates)
        assert got[i].labels == ",".join(sorted(met)) and got[i].score == pytest.approx(max(met.values(), default=0.0))


def test_hosts_of_many_labels(spark):
    rows = [(1, "http://" + "a." * 30_000 + "example.com/en/7x"), (2, "http://" + "b." * 30_000 + "x/en/"), (3, "http://..com/en/"), (4, "http://com./en/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark)).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: (None, "allow"), 3: ("com/en/", "block"), 4: (None, "allow")}
