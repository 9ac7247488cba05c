"""Near copies, pages, URLs and personal data against brute force; the pipeline's stages one by one."""

import collections
import html
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import html_text, jaccard, mixing, surrogates, url_rules
from lattica.llm.components import components

# ---- near copies


def brute_classes(rows, n, t):
    sets, parent = [], {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for a, s in enumerate(sets):
        shared = collections.Counter(b for g in s for b in held[g])
        for b, k in shared.items():
            if k * t.denominator >= t.numerator * (len(s) + len(sets[b]) - k):
                parent[find(a)] = find(b)
        for g in s:
            held[g].append(a)
    least = {}
    for a, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(a)] = min(least.get(find(a), doc), doc)
    return [(doc, len(s), least.get(find(a)) if s else doc) for a, ((doc, _), s) in enumerate(zip(rows, sets))]


def as_rows(docs):
    return [(None if pd.isna(d) else int(d), None if pd.isna(t) else t) for d, t in zip(docs.doc_id, docs.text)]


@pytest.mark.parametrize("n, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_classes(table, docs, n, t):
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in jaccard.classes(table, n, t).collect()), key=key)
    assert got == sorted(brute_classes(as_rows(docs), n, t), key=key)


def near_copies(count, words=60, edits=5, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(1000)}" for _ in range(words)]
    out = []
    for k in range(count):
        w = list(base)
        for at in rng.integers(words, size=rng.integers(0, edits)):
            w[at] = f"x{rng.integers(1000)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("parts", [False, True])
def test_a_large_class_in_parts(spark, parts, monkeypatch):
    """Blocks and runs that are split give what whole ones give."""
    if parts:
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 3_000)
        monkeypatch.setattr(jaccard, "RUN_SETS", 20)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 5)
    rows = near_copies(150) + [(1000 + k, t) for k, t in near_copies(40, seed=2)] + [(2000 + k, "exact copy of one short text here") for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, t in ((3, Fraction(7, 10)), (2, Fraction(9, 10))):
        assert sorted(tuple(r) for r in jaccard.classes(table, n, t).collect()) == sorted(brute_classes(rows, n, t))


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 200))).astype(np.uint64) for _ in range(700)]
    sizes = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s & np.uint64(15)).astype(int), minlength=16) for s in sets]).astype(np.int32)
    tree = jaccard.CountTree(points, sizes)
    for i in rng.integers(0, 700, 60).tolist():
        found = set(tree.search(points[i], int(sizes[i]), 0.4).tolist())
        real = {j for j in range(700) if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
        bound = {j for j in range(700) if np.minimum(points[i], points[j]).sum() >= 0.4 / 1.4 * (sizes[i] + sizes[j]) - 1e-6}
        assert real <= found <= bound | real


def test_keep_one(table, empty, clashing):
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    found = jaccard.classes(table)
    ids = {r.component_id for r in found.where("doc_id IS NOT NULL").collect()}
    rows = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(x for x in rows if x is not None) == sorted(ids) and rows.count(None) == 1
    assert jaccard.classes(empty).count() == 0 and jaccard.keep_one(clashing).count() == len(rows)


def test_keep_one_of_rows_that_share_ids(spark):
    """Ids beyond 2^53 beside none; exact copies under other ids go though the id has another text as well."""
    a, b, big = "one text of several words here", "quite another text with other words", 9007199254740993
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (5, b, 4), (None, a, 5), (big, "a third text that nobody else has", 6), (big + 1, "a third text that nobody else has", 7), (8, "", 8), (8, "", 9), (8, None, 9), (9, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, a), (big, "a third text that nobody else has"), (8, ""), (8, None), (9, " ")], key=str)
    assert sorted(r.doc_id for r in jaccard.classes(docs).where("doc_id > 9").collect()) == [big, big + 1]


def test_components_of_hubs(spark, monkeypatch):
    from lattica.llm import components as C

    monkeypatch.setattr(C, "HUB_EDGES", 10)
    edges = [(1000, k) for k in range(1, 400)] + [(2000, k) for k in range(350, 700)] + [(k, k + 1) for k in range(5000, 5030)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 1 for k in (*range(1, 700), 1000, 2000)}, **{k: 5000 for k in range(5000, 5031)}}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# ---- pages


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?[bi]>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body class="x"><header>top</header><div class="menu-7"><a href=/>menu</a></div>
<div class="cookie-notice">cookies</div><div class="post-12 body"><h2>Title &amp; more</h2><p>First   <b>bold</b>text&nbsp;here.<p>Second<br>line<ul><li>one<li>two &lt;x&gt;</ul>
<aside>side</aside><form>search <input></form><script>if (a<b) "<p>"</script><!-- hidden <p>no</p> --><div class="ad">buy</div><table><tr><td>a<td>b</table>tail</div>
<div id="comments"><p>a reader's long comment that goes on and on and on and on, much longer than anything else on this page, to win the vote</p></div><footer>foot</footer></body></html>"""
WANTED = "Title & more\nFirst boldtext here.\nSecond line\none\ntwo <x>\na\nb\ntail"


def test_page_of_many_parts(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE.replace("post-12", "post-9")), (3, "http://A.org", None), (4, None, ""), (5, "x", "plain text &amp; more"), (6, "http://b", "<p>un<b>closed"), (7, "http://b", "<nav>only</nav>"), (7, "http://b", "<nav>only</nav>")]
    got = collections.defaultdict(set)
    for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("TEXT", F.lit(1))).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert got == {1: {WANTED}, 2: {WANTED}, 3: {""}, 4: {""}, 5: {"plain text & more"}, 6: {"unclosed"}, 7: {""}}


def test_the_host_decides(spark):
    """A page whose own best container is another follows its host."""
    usual = '<div class="story"><p>{}</p></div><div class="extra"><p>{}</p></div>'
    rows = [(k, f"http://h.org/{k}", usual.format("main words " * 20, "few words")) for k in range(5)] + [(9, "http://h.org/9", usual.format("short main", "many other words " * 30))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "short main"


PROSE = "<p>" + "running text of the page that goes on " * 4 + "</p>"


@pytest.mark.parametrize(
    "page, count",
    [
        (f"<body><form>{PROSE * 3}<label>Name</label><input><button>go</button></form>", 3),
        (f"<article>{PROSE}<section class='related-work'>{PROSE}</section><section class='search-methods'>{PROSE}</section></article>", 3),
        (f"<div title='it's'>{PROSE}</div>", 1),
        *((f"<article>{PROSE}<{tag}>{PROSE}{PROSE}", 3) for tag in ("object", "button", "select", "iframe", "textarea")),
        (f"<article>{PROSE}<div class=related><a href=x>one</a><a href=y>running text of the page that goes on and on for a long while, in a link</a></div>", 1),
        (f"<article>{PROSE}<script>if (a < b) '{PROSE}'", 1),
        (f"<article>{PROSE}<div class='comments'>{PROSE}{PROSE}</div>", 1),
        (f"<article>{PROSE}<svg><text>drawn</text></svg><template>{PROSE}</template>{PROSE}", 2),
    ],
)
def test_what_stays_of_a_page(page, count):
    assert html_text.main_text(page, None) == "\n".join([" ".join(("running text of the page that goes on " * 4).split())] * count)


@pytest.mark.parametrize("piece", ['<div "', "<a x='\"'", '<div class="a b">', "<i>", "<iframe>", "<!-", "<", "<li><ul>", "&", "<p><span>", "</", "<a b=", "<form><p>x"])
def test_hostile_pages_take_linear_time(piece):
    import time

    page = piece * (400_000 // len(piece))
    start = time.process_time()
    html_text.main_text(page, None)
    assert time.process_time() - start < 4


def test_many_hosts(spark, monkeypatch):
    """Paths that aren't broadcast give the same texts."""
    rows = [(k, f"http://h{k % 7}.org/{k}", f"<article><h1>t</h1>{PROSE}</article>") for k in range(40)] + [(9007199254740993, None, None), (None, "x", "<p>y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted(map(str, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert sorted(map(str, html_text.extract(df).collect())) == want and any("9007199254740993" in x for x in want)


def test_page_edges(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# ---- URLs


def judged(spark, urls, rules=url_rules.BASE_RULES + url_rules.JUNK_RULES):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string").withColumn("HOST", F.lit(1))
    return [tuple(r)[2:] for r in url_rules.judge_urls(df, rules).orderBy("page_id").collect()]


def test_urls(spark):
    urls = [None, "", "a.org/x", "http://A.Example.ORG/es/1?q#f", "http://example.org/en/123", "http://notexample.org/es/", "http://org/", "http://x.org", "http://x.com/fr/", "http://com/de/x", "http://x.com/De/", "https://spam-farm.net/", "http://casino.net/x", "http://ok.net/play/casino", "ftp://ok.net/casinos", "http://h?a/b", "http://h#a/b", "http://x.org:80/", "http://a'b\\c.net/"]
    got = judged(spark, urls)
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/123", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow"), ("x.org", "", None, "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("com", "/de/x", "com/de/", "block"),
        ("x.com", "/De/", None, "allow"), ("spam-farm.net", "/", None, "block"), ("casino.net", "/x", None, "block"), ("ok.net", "/play/casino", None, "block"), ("ok.net", "/casinos", None, "allow"),
        ("h", "", None, "allow"), ("h", "", None, "allow"), ("x.org:80", "/", None, "allow"), ("a'b\\c.net", "/", None, "allow"),
    ]


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("common.example", "/rare"), ("common.example", "/")], "__host string, __path string")
    rules = (url_rules.pattern_rule("x", ("common", "rare", "example"), "block"), url_rules.pattern_rule("y", (), "block"))
    index, always = url_rules.build_index(urls, rules)
    assert [e for p in index for e in p] == [("rare", 0)] and always == [1]


def test_rules_of_a_table(spark, sf_dir):
    """Joined rules judge as those in the plan do; a rule without a token is refused."""
    rules = url_rules.BASE_RULES + url_rules.JUNK_RULES
    schema = "pattern string, tokens array<string>, verdict string, rank int, label string"
    held = spark.createDataFrame([(r.pattern, list(r.tokens), r.verdict, r.rank, r.label) for r in rules], schema)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "http://casino.net/" + "x/" * 50_000 + "poker"), (-3, "x")], "page_id bigint, url string"))
    want = sorted(map(str, url_rules.judge_urls(pages).collect()))
    assert sorted(map(str, url_rules.judge_urls(pages, held).collect())) == want
    with pytest.raises(ValueError):
        url_rules.judge_urls(pages, spark.createDataFrame([("x", [], "block", 1, None)], schema))


def test_url_edges(spark):
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert judged(spark, ["http://a.b/c"], ()) == [("a.b", "/c", None, "allow")]


# ---- personal data


KEY = b"a key of the tests"


@pytest.fixture(scope="module")
def p():
    return surrogates.Permuter(b"k" * 32)


def test_permutations_are_permutations(p):
    for n in (2, 10, 37, 100):
        out = [p.number(x, n, "t") for x in range(n)]
        assert sorted(out) == list(range(n)) and all(a != b for a, b in enumerate(out))
    even = [p.number(x, 50, "t", lambda y: y % 2 == 0) for x in range(0, 50, 2)]
    assert sorted(even) == list(range(0, 50, 2)) and all(a != b for a, b in zip(even, range(0, 50, 2)))
    assert len({p.text(f"a{k}B", "t") for k in range(10)}) == 10


def test_listed_names_are_permuted_without_fixed_ones(p):
    for group, names in surrogates.GIVEN.items():
        out = [surrogates._name(p, n) for n in names]
        assert sorted(out) == sorted(names) and all(a != b for a, b in zip(out, names)) and len(set(names)) == len(names) <= 200, group


def test_surrogates_keep_types(p):
    text = "Mail a.b@x.example.com, call +1 (743) 555-3824 or (212) 555-0100; card 4485 7581 2888 9439 and 4111111111111111; 10.1.2.3 and 8.8.8.8; key = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"; ssn 123-45-6789. Mrs. Maria Weber met Mr Paul and г-н; господин Иван."
    out, found = surrogates.replace(text, p)
    by = collections.defaultdict(list)
    for kind, a, b in found:
        assert a != b and a not in out
        by[kind].append((a, b))
    assert set(by) == {"email", "phone", "card", "ip", "secret", "ssn", "name"}
    for kind, pairs in by.items():
        for a, b in pairs:
            if kind != "name":
                shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "9", s))
                assert kind in ("ip", "secret") or shape(a) == shape(b)
    assert by["email"][0][1].endswith(".example.com") and by["ip"][0][1].startswith("10.") and re.fullmatch("[0-9a-f]{40}", by["secret"][0][1])
    assert [x[1][0] for x in by["card"]] == ["4"] and surrogates._is_card(by["card"][0][1]) and "4485 7581 2888 9439" in out  # a number that doesn't check is none
    names = [x for _, x in by["name"]]
    assert names[0] in surrogates.GIVEN["latin", "f"] and names[2] in surrogates.GIVEN["latin", "m"] and names[3] in surrogates.GIVEN["cyrillic", "m"] and names[1].istitle()
    assert surrogates.replace(text, p)[0] == out and surrogates.replace(text, surrogates.Permuter(b"other"))[0] != out


def test_one_entity_in_every_writing(p):
    """All writings of an entity get one surrogate, different entities different ones, and nobody keeps their own."""
    rng = np.random.default_rng(2)
    seen = collections.defaultdict(set)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    for _ in range(150):
        a, b, c = f"{rng.integers(2, 10)}{digits(2)}", f"{rng.integers(2, 10)}{digits(2)}", digits(4)
        body = f"4{digits(14)}"
        card = body + str(surrogates._luhn(body))
        account = digits(18)
        iban = f"DE{surrogates._iban_check('DE', account):02d}{account}"
        user = f"u{digits(4)}"
        writings = {
            ("phone", a + b + c): [f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+1{a}{b}{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}"],
            ("card", card): [card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))],
            ("iban", iban): [iban, " ".join(iban[i : i + 4] for i in range(0, 22, 4))],
            ("email", user): [f"{user}@host.de", f"{user.upper()}@Host.DE"],
        }
        for entity, ways in writings.items():
            for way in ways:
                out, found = surrogates.replace(f"see {way} AND more", p)
                assert [x[:2] for x in found] == [(entity[0], way)] and out == f"see {found[0][2]} AND more"
                got = surrogates.normal(entity[0], found[0][2])
                assert got != surrogates.normal(entity[0], way)
                seen[entity].add(got)
                if entity[0] == "iban":
                    plain = found[0][2].replace(" ", "")
                    assert int(plain[2:4]) == surrogates._iban_check("DE", plain[4:])
    assert all(len(x) == 1 for x in seen.values()) and len({(k[0], *x) for k, x in seen.items()}) == len(seen)
    for way in ("DE00370400440532013000", "DE12370400440532013000"):  # invalid ones stay invalid
        got = surrogates._iban(p, way)
        assert int(got[2:4]) != surrogates._iban_check("DE", got[4:])


@pytest.mark.parametrize("secret", ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "AKIA" + "Q7" * 8, "AKIA" + "QZ" * 8, "ghp_" + "aB3" * 12, "sk-" + "aB" * 12, "sk-proj-" + "aB_3-" * 8, "xoxb-12345-abcdef", "hf_" + "aB" * 17, "glpat-" + "aB3" * 7])
def test_secrets_after_anything_but_a_word(p, secret):
    for before in ("", "\n", "\t", "(", ",", "[", "<", "key="):
        out, found = surrogates.replace(f"{before}{secret}\n", p)
        assert [x[:2] for x in found] == [("secret", secret)] and secret not in out
    assert surrogates.replace(f"x{secret}", p)[1] == [] and surrogates.replace(f"x_{secret}", p)[1] == []


def test_names_do_not_collide(p):
    """All words of a form, after any title and in any place of a name, have one surrogate each."""
    small, letters = "abcdefghijklmnopqrstuvwxyz", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
    for words in ([a.upper() + b for a in small for b in small], [a + b for a in letters for b in letters]):
        out = collections.defaultdict(set)
        for w in words:
            for text in (f"Mr {w}", f"Ms {w}", f"Mr Paul {w}"):
                out[w].add(surrogates.replace(text, p)[0].split(" ")[-1])
        assert all(len(s) == 1 for s in out.values()) and len(set.union(*out.values())) == len(words)


def test_later_mentions_follow(p):
    out, found = surrogates.replace("Smythe wrote. Mr John Smythe and Mr Smythe came; John Smythe and Smythe's Smythes left, and smythe.", p)
    names = dict(x[1:] for x in found)
    john, smythe = names["John"], names["Smythe"]
    assert smythe != "Smythe" and john != "John"
    assert out == f"{smythe} wrote. Mr {john} {smythe} and Mr {smythe} came; {john} {smythe} and {smythe}'s Smythes left, and smythe."


def test_untitled_names(p):
    out, found = surrogates.replace("John Miller and Анна Иванова came. Miller left; Paul said so, and the Johnson family.", p)
    assert [x[1] for x in found] == ["John", "Miller", "Анна", "Иванова", "Miller"] and "Paul said so, and the Johnson family." in out
    family = dict(x[1:] for x in found)["Miller"]
    assert all((c in "aeiou") == (d in "aeiou") for c, d in zip("iller", family[1:]))


def test_phone_and_email_classes_do_not_share_surrogates(p):
    for digits in ("1234567890", "2134567890", "0014567890"):
        out = re.sub(r"\D", "", surrogates._phone(p, f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"))
        assert [c in "23456789" for c in (out[0], out[3])] == [c in "23456789" for c in (digits[0], digits[3])]


def test_clean_texts_stay(p):
    for text in ("", "Nothing here 12 345 or 3.14 or 1.2.3 or v1.2.3.4.5", "on 2024-01-02 at 10:30", "Mr and mrs", "a @ b", "1,000,000 people"):
        assert surrogates.replace(text, p) == (text, [])


def test_surrogates_over_a_table(table, empty, clashing):
    found = surrogates.pseudonymise(table, KEY)
    assert surrogates.collisions(found).count() == 0 and found.where("doc_id < 9000 AND n_entities > 0").count() > 0
    assert found.where("text IS NULL").count() == 1 and surrogates.pseudonymise(empty, KEY).count() == 0
    assert surrogates.pseudonymise(clashing, KEY).where("size(entities) <> n_entities").count() == 0
    originals = [r.o for r in found.select(F.explode("entities.original").alias("o")).distinct().collect()]
    texts = [r.text for r in found.where("text IS NOT NULL").collect()]
    assert not any(o in t for o in originals for t in texts)


def test_collisions_are_found(spark):
    e = "array<struct<type:string,original:string,surrogate:string>>"
    df = spark.createDataFrame([(2, [("ip", "a", "x"), ("ip", "b", "x")]), (2, [("ip", "a", "y"), ("ip", "q", "q")])], f"n_entities int, entities {e}")
    assert {(r.value, r.side) for r in surrogates.collisions(df).collect()} == {("x", "surrogate"), ("a", "original"), ("q", "same")}


def test_a_collision_changes_the_key(table, monkeypatch):
    real, calls = surrogates.collisions, []
    monkeypatch.setattr(surrogates, "collisions", lambda found: calls.append(1) or (found if len(calls) == 1 else real(found)))
    first = surrogates.checked(table.where("text IS NOT NULL"), KEY)
    assert len(calls) == 2 and first.columns == [*table.columns, "n_entities", "entities"]
    monkeypatch.setattr(surrogates, "collisions", lambda found: found)
    with pytest.raises(RuntimeError):
        surrogates.checked(table, KEY)
    with pytest.raises(ValueError):
        surrogates.pseudonymise(table, b"")


# ---- the pipeline


def test_pipeline(spark, table, docs, sf_dir, tmp_path):
    import corpus_pipeline
    from lattica.llm.common import materialise

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near copies", "decontamination", "personal data", "mixing"]
    held, seen = table, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, held, sf_dir), "test")
        if name != "mixing":
            assert out.columns == table.columns
        seen.append((name, held, out))
        held = out
    before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in seen[0][1:])
    assert before - after == {9001, 9002, 9003, 9004}
    classes = {r[0]: r[2] for r in brute_classes([(r.doc_id, r.text) for r in seen[1][1].collect()], 5, Fraction(4, 5))}
    assert {r.doc_id for r in seen[1][2].collect() if r.doc_id is not None} == {v for k, v in classes.items() if k is not None}
    from lattica.llm import decontaminate as D

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert D.find_overlap(seen[2][1], items).where("contaminated").count() > 0 and D.find_overlap(seen[2][2], items).where("contaminated").count() == 0
    assert {tuple(r) for r in D.find_overlap(seen[2][1], items).where("NOT contaminated").select("doc_id", "text").collect()} <= {tuple(r) for r in seen[2][2].select("doc_id", "text").collect()}
    originals = [r.o for r in surrogates.pseudonymise(seen[3][1], KEY).select(F.explode("entities.original").alias("o")).collect()]
    assert originals and not any(o in r.text for r in seen[3][2].collect() for o in originals)
    final = held.collect()
    sizes = sorted(len((r.text or "").encode().split()) for r in seen[3][2].collect())
    assert sorted(r.size for r in final) == sizes and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in final)


def test_pipeline_of_nothing(spark, empty, sf_dir):
    import corpus_pipeline

    held = empty
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, sf_dir)
    assert held.count() == 0


def test_pipeline_ends_with_the_cleaned_texts(spark, table, sf_dir):
    """Rows of one doc_id, of none and equal ones each come out once, with their text and its own size."""
    import corpus_pipeline

    docs = table.where("doc_id < 100 OR doc_id IS NULL OR doc_id >= 9000").unionByName(table.where("doc_id = 9006").withColumn("text", F.lit("another text of this id")))
    got = corpus_pipeline.mixed(spark, docs, sf_dir)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    assert collections.Counter(tuple(r) for r in got.select(*docs.columns).collect()) == collections.Counter(tuple(r) for r in docs.collect())
    assert all(r.size == len((r.text or "").encode().split()) and r.taken == r.copies * r.size for r in got.collect())
    narrow = mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.first("target").alias("t"))
    wide = got.groupBy("source").agg(F.count("*").alias("n"), F.first("target").alias("t"))
    assert {tuple(r) for r in wide.collect()} == {tuple(r) for r in narrow.collect()}
