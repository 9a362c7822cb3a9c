"""HTML, tokens, chat, search, classifier and pipeline."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlark.llm import chat, fm_index, html_extract, quality, token_counts, topk_search

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>no";</script></head><body class="home">
<header class="site-header"><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies</div>{article}<aside><p>Side text that is long enough to look like something to read.</p></aside>
<section id="comments"><article class="comment"><p>First! A reader comment of some length, with words and more words.</p></article></section>
<form><label>Search</label><input></form><footer>&copy; all rights</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p>One  two\n three&nbsp;<b>bo</b>ld.<br>Next<p>Unclosed <i>para<div class='ad'>Buy</div><ul><li>a<li>b</ul><!-- c --><p>End &eacute; &#233; &lt;tag&gt;"
WANT = "Head & line\nOne two three bold. Next\nUnclosed para\na\nb\nEnd é é <tag>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<form id=aspnet><article>{}</article></form>", "<nav><a href=x>menu never closed</a><article>{}</article>"])
def test_html_article(wrap):
    assert html_extract.main_text(PAGE.format(article=wrap.format(BODY))) == WANT


def test_html_without_marks_needs_a_surge():
    text = "A paragraph that is certainly long enough to count as the text of a page, with more than eighty characters."
    page = f"<body><div><a href=x>link one</a></div><div><a href=y>link two</a></div><p>{text}</p><p>{text}</p><p>short end</p></body>"
    assert html_extract.main_text(page) == f"{text}\n{text}\nshort end"


def test_html_marks_shift_weights():
    text = "A paragraph that is certainly long enough to count as the text of a page, with more than eighty characters."
    long = " ".join([text] * 6)
    links = "<p><a href=x>more</a></p>" * 4
    # far denser text outside a mark weighs enough, as other text does not
    page = f"<body><article><p>Teaser</p></article>{links}<div><p>{long}</p><p>{long}</p></div>{links}<p>alone</p></body>"
    assert html_extract.main_text(page) == f"Teaser\n{long}\n{long}"
    assert html_extract.main_text(f"<body><article>Tiny news item.</article><div><p>{text}</p><p>{text}</p></div></body>") == "Tiny news item."
    # a less sure mark weighs less than the surest and more than none
    assert html_extract.main_text(f"<body><main><article><p>Teaser</p></article><p>{text}</p></main><p>{text}</p></body>") == f"Teaser\n{text}"
    assert html_extract.main_text(f"<body><article><p>{text}</p><p>{text}</p></article><div><p>{text}</p></div></body>") == f"{text}\n{text}"


BLURB = "Words that fill a paragraph of the article, and go on for a while, as paragraphs do, until they end."


def made_page(rng):
    """A page put together from known parts, and the text of its article."""
    junk = ["<nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(rng.randint(1, 9))) + "</ul></nav>", "<div class='ad'>Buy this, buy that, buy it all, and buy it now!</div>", "<div id=cookie-notice><p>We use cookies.</p><p>You agree.</p></div>", "<aside><p>Something else to read on this site.</p></aside>", "<form><label>Mail</label><input></form>", "<script>var a='<p>no</p>'</script>", "<!-- <p>nor this</p> -->", "<div class='comments'><p>First! I was here before all others.</p></div>", ""]
    texts, inner = [], []
    for _ in range(rng.randint(1, 30)):
        t = rng.choice(["Yes.", "A short one", BLURB, BLURB[: rng.randint(10, 90)].strip(), f"{BLURB} {BLURB}"])
        texts.append(t)
        inner.append(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<p><a href=x>{}</a></p>", "<div><p>{}</div>"]).format(t.replace(" ", rng.choice([" ", "  ", "\n"]), 1)))
        if rng.random() < 0.2:
            inner.append(rng.choice(junk[1:]))
    tag = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>"])
    return "<html><head><title>T</title></head><body>" + "".join(rng.sample(junk, 4)) + tag.format("".join(inner)) + "".join(rng.sample(junk, 3)) + "<footer>All rights are reserved by those who have them.</footer></body></html>", "\n".join(texts)


def test_html_of_made_pages():
    rng = random.Random(21)
    pages = [made_page(rng) for _ in range(300)]
    assert [html_extract.main_text(p) for p, _ in pages] == [t for _, t in pages]


def unmarked_page(rng):
    """Paragraphs without a mark, links between them, and bare lines of navigation at a distance."""
    linked = lambda k: f"<div><a href='/{k}'>{BLURB}</a></div>"
    bare = "".join(f"<div>{w}</div>" for w in rng.sample(["Home", "About us", "Log in", "Top"], rng.randint(1, 2)))
    gap = "".join(map(linked, range(3)))
    texts, inner = [], []
    for k in range(rng.randint(3, 9)):
        t = rng.choice(["Yes.", BLURB, f"{BLURB} {BLURB}"]) if k else BLURB
        texts.append(t)
        inner.append(f"<p>{t}</p>")
        if k == 1 or rng.random() < 0.3:  # a paragraph that is all link, between two others
            inner.append(linked(0))
            texts.append(BLURB)
    if inner[-1] == linked(0):
        inner.append("<p>Yes.</p>")
        texts.append("Yes.")
    return f"<body>{bare}{gap}<div>{''.join(inner)}</div>{gap}{bare}</body>", "\n".join(texts)


def test_html_surges_and_dives_bound_the_text():
    rng = random.Random(5)
    pages = [unmarked_page(rng) for _ in range(100)]
    assert [html_extract.main_text(p) for p, _ in pages] == [t for _, t in pages]
    # one line at a time loses the links between paragraphs; without a contrast every bare line is a surge
    assert not any(html_extract.main_text(p, window=1) == t for p, t in pages)
    assert not any(html_extract.main_text(p, contrast=1e9) == t for p, t in pages)


WRAPPED = ["<div class='layout has-sidebar'>{}</div>", "<div class='wrap no-sidebar'><article>{}</article></div>", "<div class='post social'>{}</div>", "<article class='post menu-review'>{}</article>", "<form class=page>{}</form>", "<section id=with-comments>{}</section>", "<div class='dialog'><div>{}</div></div>"]
WITHIN = ["<div class='related-work'><p>{}</p></div>", "<section class='form-theory'><p>{}</p></section>", "<p class='no-ad'>{}</p>", "<ul><li class=item>{}</ul>", "<h2 id=search-methods>{}</h2>", "<blockquote>{}</blockquote>"]
AWAY = ["<p class='advert'>BUY NOW</p>", "<ul><li class='ad'>Buy this<li class=ad-slot>and this</ul>", "<h3 class='related-posts'>More</h3>", "<div class='comment-list'><p>First!</p></div>", "<p hidden>Not seen</p>", "<div class='ad-300x250'>Ad</div>", "<div id=newsletter-signup><p>Mail</p></div>", "<div class='siteFooter'><p class=social-links>x</p></div>", "<nav class=main-nav>a</nav>", "<ol class=comments><li><p>One</p><li>Two</ol>"]


@pytest.mark.parametrize("wrap", WRAPPED)
def test_html_names_of_wrappers(wrap):
    body = f"<p>{BLURB}</p>{''.join(AWAY)}<p>Yes.</p>" + "".join(w.format(f"Kept {k}") for k, w in enumerate(WITHIN))
    want = "\n".join([BLURB, "Yes.", *(f"Kept {k}" for k in range(len(WITHIN)))])
    assert html_extract.main_text(f"<body>{wrap.format(body)}<footer>{BLURB}</footer></body>") == want


def test_html_comments_may_be_most_of_a_page():
    comments = f"<div class=comments>{f'<p>{BLURB}</p>' * 30}</div>"
    assert html_extract.main_text(f"<body><article><p>Short.</p>{comments}</article>{comments}</body>") == "Short."
    assert html_extract.main_text(f"<body><div><p>Short.</p>{comments}</div></body>") == "Short."


def test_html_surges_against_brute_force():
    """A line is kept if it lies in a stretch that begins with a surge, window by window."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 25)
        w, window, contrast = np.array([rng.choice([-300.0, 0, 0, 1, 5, 30, 300]) for _ in range(n)]), rng.randint(1, 4), rng.choice([2, 16, 1e9])
        block = lambda i: sum(max(x, 0) for x in w[i : i + window])
        surge = min(html_extract.LEAST, max(map(block, range(n)), default=0) / contrast)
        kept, on = [], False
        for i in range(n):
            on = on and block(i) > 0 or w[i] > 0 and block(i) >= surge
            if on:
                kept.append(i)
        assert kept == [i for a, b in html_extract.surges(w, window, contrast) for i in range(a, b)]


def test_html_short_pages_keep_their_text():
    assert html_extract.main_text("<body><p>Hello.</p></body>") == "Hello."
    assert html_extract.main_text("<body><nav><a href=x>Home</a></nav><div><p>Hello.</p><p>Bye.</p></div><footer>Foot</footer></body>") == "Hello.\nBye."
    assert html_extract.main_text("<body><nav><a href=x>Home</a></nav><footer>Foot</footer></body>") == ""


def test_surges():
    assert html_extract.surges(np.array([0, 0, 50, 60, 0, 10, 0, 0, 0, 90]), 3, 3) == [(2, 6), (9, 10)]
    assert html_extract.surges(np.array([]), 3, 1) == []


def test_html_rows(spark):
    rows = [(1, "u", PAGE.format(article=f"<article>{BODY}</article>"), "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "<p>x" + "y" * 200_000, "c"), (4, "u", "<script>never closed", "c"), (None, "u", "<<>> a < b", "c")]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [(r.page_id, r.n_chars) for r in got][1:5] == [(2, 0), (3, 0), (4, 200_001), (4, 0)] and got[0].text == WANT
    assert html_extract.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = token_counts.read_vocabulary(VOCABULARY)
    t = Tokenizer(models.Unigram(v.pieces, 0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="first", split=True)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc éèn ß\n.,日😀▁") for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", " ", "  a  b", "▁▁", "<s>", "\x00", "word " * 5000, "x" * 3000]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    rows = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)] + [(999, None, 7)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, v).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[999] == 0
    assert token_counts.count_tokens(rows.limit(0), v).count() == 0


def counted_plainly(vocabulary, part):
    """All segmentations of a part end by end, as the tie rules are stated."""
    scores = dict(vocabulary.pieces)
    least = min(scores.values()) - 10
    best = [(0.0, 0, False)]
    for end in range(1, len(part) + 1):
        found = None
        for start in range(end):
            piece = part[start:end]
            if piece in scores and (found is None or best[start][0] + scores[piece] > found[0]):
                found = (best[start][0] + scores[piece], best[start][1] + 1, False)
        if part[end - 1] not in scores:
            s, n, odd = best[end - 1]
            if found is None or s + least > found[0]:
                found = (s + least, n + (len(part[end - 1].encode()) if vocabulary.byte_fallback else 0 if odd else 1), True)
        best.append(found)
    return best[-1][1]


@pytest.mark.parametrize("fallback", [False, True])
def test_token_counts_against_all_segmentations(fallback):
    rng = random.Random(14)
    for _ in range(60):
        pieces = {"".join(rng.choice("abé▁") for _ in range(rng.randint(1, 4))) for _ in range(12)}
        v = token_counts.Vocabulary([(p, rng.choice([-1.0, -2.0, -2.5, -3.0])) for p in sorted(pieces)], fallback)
        c = token_counts.Counter(v)
        for _ in range(20):
            part = "▁" + "".join(rng.choice("abézß日") for _ in range(rng.randint(0, 12)))
            assert c.part(part) == counted_plainly(v, part)


def test_token_ties_and_unknowns():
    v = token_counts.Vocabulary([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)], False)
    c = token_counts.Counter(v)
    assert c.count("aa") == 2  # ▁a + a ties with ▁ + aa; the earlier start wins at each end
    assert c.count("zz") == 2 and c.count("z a") == 3


def test_chat_round_trip():
    rng = random.Random(5)
    for _ in range(300):
        turns = [("".join(rng.choice(["user", "assistant", "\n", "\\", "<|", "|>"]) for _ in range(rng.randint(0, 3))), "".join(rng.choice(["<|im_end|>", "<|im_start|>", "<", "\\", "|", "\n", "é", "ok"]) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        c = chat.render(turns)
        assert chat.parse(c.text) == turns
        assert [chat.unescape(c.text[a:b]) for a, b in c.loss] == [t for r, t in turns if r == "assistant"]
        assert c.text.count("<|im_start|>") == len(turns)


def test_chat_events(spark):
    e = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", "assistant", "lo"), (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "Bye"),
        (1, 6, 2, "message", "user", "old"), (1, 7, 0, "edit", "user", "hello"), (1, 8, 1, "regenerate", "assistant", None), (1, 9, 1, "delta", "assistant", "Yes"), (2, 1, 0, "message", None, None), (None, 1, None, "message", "user", "x"),
    ]
    got = {r.conv: r for r in chat.format_chats(spark.createDataFrame(e, "conv bigint, seq bigint, turn bigint, kind string, role string, text string")).collect()}
    assert chat.parse(got[1].formatted) == [("user", "hello"), ("assistant", "Yes")]
    assert chat.parse(got[2].formatted) == [("", "")] and got[None].n_turns == 1


LOG = "conv bigint, seq bigint, turn bigint, message string, kind string, role string, text string, log int"


def folded_plainly(events):
    """Brute force: the whole state after each event, in order."""
    key = lambda x: (x is not None, x or 0)
    name = lambda x: (x is not None, x or "")
    state = []  # [turn, message, role, text]
    for _, seq, turn, message, kind, role, text in sorted(events, key=lambda e: (key(e[1]), key(e[2]), *map(name, (e[3], e[6], e[4], e[5])))):
        mine = [m for m in state if m[1] == message]
        if not mine:
            state.append([key(turn), message, None, ""])
            mine = state[-1:]
        m = mine[0]
        m[2] = role if m[2] is None else m[2]
        m[3] = {"message": text or "", "edit": text or "", "regenerate": ""}.get(kind, m[3] + (text or ""))
        if kind == "edit":
            state = [x for x in state if x[0] <= m[0]]
    return [(r, t) for _, r, t in sorted((m[0], m[2] or "", m[3]) for m in state)]


def test_chat_logs_against_a_plain_fold(spark):
    rng = random.Random(17)
    logs = {}
    for c in [None, *range(60)]:
        turn_of = {m: rng.choice([None, 0, 1, 2, 3]) for m in "abcdef"}
        logs[c] = []
        for k in range(rng.randint(1, 30)):
            m = rng.choice("abcdef")
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            logs[c].append((c, k if rng.random() < 0.8 else rng.randint(0, k), turn_of[m], m, kind, rng.choice([None, "user", "assistant", "a\nb"]), rng.choice([None, "", "<|im_end|>", "x", "é\n"])))
    logs[100] = [(100, 0, 0, "a", "message", "user", "<|im_start|>" * 50_000)] + [(100, k, 1, "b", "delta", "assistant", f"{k}|") for k in range(1, 20_000)]
    rows = [(*e, 5) for log in logs.values() for e in log]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).repartition(5)
    got = {r.conv: r for r in chat.format_chats(df).collect()}
    assert got.keys() == logs.keys()
    for c, log in logs.items():
        want = folded_plainly(log)
        assert chat.parse(got[c].formatted) == want and got[c].n_turns == len(want)
        assert "".join(chat.unescape(got[c].formatted[s.start : s.end]) for s in got[c].loss) == "".join(t for r, t in want if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0
    # finished turns go through the log and come back
    table = spark.createDataFrame([(1, 0, "user", "q" * 40), (1, 1, "assistant", "streamed text, é, in pieces"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "abc")], "conv_id bigint, turn bigint, role string, text string")
    events = chat.rows_as_events(table)
    assert {r.kind for r in events.collect()} == {"message", "edit", "delta", "regenerate"}
    assert chat.parse(chat.format_chats(events).first().formatted) == [("user", "q" * 40), ("assistant", "streamed text, é, in pieces"), ("user", ""), ("assistant", ""), ("assistant", "abc")]
    assert chat.rows_as_events(table.limit(0)).count() == 0


def test_chat_rows_that_tie(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, None, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.format_chats(chat.rows_as_events(rows)).first()
    assert chat.parse(r.formatted) == [("user", ""), ("assistant", "a"), ("user", "b"), ("user", "b")]


def brute_top(rows, k, every):
    out = []
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {q: min(v for i, v in sound if i == q) for q, _ in sound if q % every == 0}
    for q, own in asks.items():
        ranked = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for i, v in sound if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk_search, "SHARD", 50)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(1000, None), (1010, [0.0] * 6), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1030, [float("nan")] * 6), (1040, [1.0, 2.0]), (1041, [2.0, 1.0]), (None, [1.0] * 6), (1050, [1e12] * 6), (1060, []), (1061, [])]
    rows += [(2000 + i, [0.25] * 6) for i in range(40)] + [(1070, [9.0] * 6), (1070, [-9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(df, 10, every=10).collect())
    assert got == brute_top(rows, 10, 10)
    assert topk_search.top_k(df.limit(0), 10).count() == 0


def test_threshold_algorithm_stops_early():
    v = np.zeros((5000, 4))
    v[:, 0] = np.arange(5000)
    seen = []

    class Spy(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, np.ndarray) and k.ndim == 1:
                seen.append(len(k))
            return super().__getitem__(k)

    ids, scores = topk_search.threshold_top_k(np.argsort(v, axis=0, kind="stable"), v.view(Spy), np.arange(5000), np.array([1.0, 0, 0, 0]), -1, 3)
    assert ids.tolist() == [4999, 4998, 4997] and sum(seen) < 500


def test_fm_index_against_scan():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(9)]).astype(np.int32)
    index = fm_index.FMIndex(text, 3)
    for length in (1, 2, 4):
        patterns = rng.integers(1, 4, (20, length))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    hidden = rng.random(20_000) < 0.3
    accuracy = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(len(hidden)) < 0.2, quality.ABSTAIN, np.where((rng.random(len(hidden)) < a) == hidden, quality.BAD, quality.GOOD)) for a in accuracy], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert np.abs(model.accuracy() - accuracy).max() < 0.05 and abs(model.prior - 0.3) < 0.05
    assert ((model.posterior(patterns)[inverse] > 0.5) == hidden).mean() > 0.91


def test_label_model_against_plain_em():
    """The same steps written out per pattern and labeller, without arrays."""
    rng = random.Random(2)
    patterns = sorted({tuple(rng.choice([0, 0, 1, 2, 2]) for _ in range(4)) for _ in range(40)})
    counts = [rng.randint(1, 200) for _ in patterns]
    p = []
    for v in patterns:
        bad, good = v.count(quality.BAD), v.count(quality.GOOD)
        p.append(0.95 if bad >= 2 or bad == 1 and not good else 0.3 if bad == 1 else 0.02)
    for _ in range(25):
        prior = min(max(sum(a * n for a, n in zip(p, counts)) / sum(counts), 1e-4), 1 - 1e-4)
        table = {}
        for c in (0, 1):
            for k in range(4):
                got = [0.1 + sum((a if c else 1 - a) * n for a, n, v in zip(p, counts, patterns) if v[k] == vote) for vote in range(3)]
                table[c, k] = [g / sum(got) for g in got]
        like = [[math.prod(table[c, k][v[k]] for k in range(4)) for c in (0, 1)] for v in patterns]
        p = [b * prior / (b * prior + a * (1 - prior)) for a, b in like]
    model = quality.estimate(np.array(patterns), np.array(counts, dtype=float), rounds=25)
    assert model.prior == pytest.approx(prior, abs=1e-9) and model.posterior(np.array(patterns)) == pytest.approx(p, abs=1e-9)


def made_documents(n=1500, seed=6):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = [f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.choice('ln')}{rng.choice(['', 'ta', 'ro', 'mi'])}" for _ in range(rng.randint(30, 300))]
        kind = i % 8
        if kind == 0:
            for k in rng.sample(range(len(w)), max(3, len(w) // 40)):
                w[k] = "zorgu" + rng.choice(["x", "an", "elt", "ip"])
        elif kind == 1:
            w = [x + rng.choice(["###", "%%%"]) for x in w]
        elif kind == 2:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, int(kind == 0)))
    return rows, marks


def test_classifier_on_held_out_documents(spark):
    rows, marks = made_documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(9000, None, "x"), (9001, "", "x"), (0, rows[0][1], "x")], "doc_id bigint, text string, keep string")
    labels = spark.createDataFrame([(i, t, int(i % 8 not in (1, 2))) for i, t in marks if i % 16 < 8] + [(None, 1, 0), (16, None, None), (3, None, 0), (3, 0, 1)], "doc_id bigint, toxic int, quality int")
    scored = quality.classify(docs, labels).collect()
    got = {r.doc_id: r.keep for r in scored}
    assert len({(r.junk_score, r.toxic_score) for r in scored if r.doc_id == 0}) == 1 and sum(r.doc_id == 0 for r in scored) == 2
    held = [i for i, _ in rows if i % 16 >= 8]
    wrong = [i for i in held if got[i] != (i % 8 > 2)]
    assert len(wrong) <= 0.02 * len(held) and not got[9000] and not got[9001]


def test_classifier_without_labels_or_rows(spark):
    rows, _ = made_documents(200)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.keep for r in quality.classify(docs, none).collect()}
    assert not any(got[i] for i in got if i % 8 in (1, 2)) and sum(got[i] for i in got if i % 8 > 2) >= 120
    assert quality.classify(docs.limit(0), none).count() == 0


def test_classifier_of_ids_that_repeat_and_of_strings(spark):
    """One id ten thousand times, each time with another text, is one document of the samples."""
    rows, marks = made_documents(160)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", t, int(i % 8 not in (1, 2))) for i, t in marks], "doc_id string, toxic int, quality int")
    many = spark.range(10_000).select(F.lit("d0").alias("doc_id"), F.concat(F.lit("plain words of text number "), F.col("id").cast("string")).alias("text"))
    got = quality.classify(docs.unionByName(many), labels)
    assert got.count() == 10_160 and got.where("doc_id = 'd0'").count() == 10_001
    sampled = quality._one_each(many.withColumnRenamed("doc_id", "id"))
    assert sampled.count() == 1


def test_features_are_per_text():
    one = [quality.Features(pa.array([t])).all()[0][0].tolist() for t in ("a b c", "", "zz zz zz")]
    many = [x.tolist() for x in quality.Features(pa.array(["a b c", "", "zz zz zz"])).all()[0]]
    assert one == many


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, marks = made_documents(400)
    good = [i for i, _ in rows if i % 8 > 2]
    passage = " ".join(f"bench{k}" for k in range(30))
    extra = [(1000, rows[good[0]][1]), (1001, passage + " " + rows[good[1]][1][:100]), (1002, None)]
    texts = [(i, t + ("\nshared footer line" if i % 2 else "")) for i, t in rows] + extra
    full = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, toxic int").selectExpr("doc_id", "1 quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == before.columns
        left.append({r.doc_id: r for r in docs.collect()})
    kept = set(good) | {1000, 1001}
    assert len(set(left[0]) ^ kept) <= 8 and not any(i in left[0] for i in (1, 2, 9, 10))
    assert not any("shared footer" in r.text for r in left[1].values()) and all(r.n_chars == len(r.text) for r in left[1].values())
    assert 1000 not in left[2] and good[0] in left[2]
    assert set(left[2]) - set(left[3]) == {1001}
    assert set(left[4]) <= set(left[3]) and all(r.taken == r.copies * r.size for r in left[4].values())


def test_pipeline_rows_that_share_an_id(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stage = {f.__name__: f for _, f in corpus_pipeline.STAGES}
    ids = [None, None, None, 7, 7, 7]

    def after(name, texts, ids=ids):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)
        return docs, stage[name](spark, docs, str(tmp_path)).collect()

    def kept(name, texts, ids=ids):
        return sorted(((r.doc_id, r.text) for r in after(name, texts, ids)[1]), key=str)

    words = [" ".join(f"{name}{k}" for k in range(40)) for name in "abcdef"]
    # lines: each row loses its own common lines, and keeps its own text or the lack of one
    ten = [(i, f"common\n{i}") for i in range(100, 110)]
    got = after("lines", [f"common\n{w}" if k % 3 else w for k, w in enumerate(words)] + [None] + [t for _, t in ten], [*ids, None] + [i for i, _ in ten])[1]
    assert sorted([(r.doc_id, r.text, r.n_chars) for r in got if (r.doc_id or 0) < 100], key=str) == sorted([(i, w, len(w)) for i, w in zip(ids, words)] + [(None, None, 0)], key=str)
    # near copies: one of each group, one with an id before one without
    assert kept("near_copies", [words[0], words[0], words[1], words[1], words[2], words[2]]) == sorted([(None, words[0]), (7, words[1]), (7, words[2])], key=str)
    # decontamination
    spark.createDataFrame([(1, words[0]), (2, words[3])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert kept("decontamination", words) == sorted([(i, w) for k, (i, w) in enumerate(zip(ids, words)) if k not in (0, 3)], key=str)
    # mixing: each row once, with its own size
    docs, got = after("mixing", [" ".join(w.split()[: 10 + 3 * k]) for k, w in enumerate(words)])
    assert sorted(r.size for r in got) == sorted(len(r.text.split()) for r in got) and len({r.text for r in got}) == len(got) > 0
    # quality
    rows, marks = made_documents(400)
    spark.createDataFrame(marks, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = [rows[3][1], rows[0][1], rows[8][1], rows[4][1], rows[1][1], rows[9][1]]
    separate = dict(kept("quality", [t for _, t in rows] + extra, [i for i, _ in rows] + list(range(1000, 1006))))
    shared = kept("quality", [t for _, t in rows] + extra, [i for i, _ in rows] + [None] * 6)
    assert sorted(t for i, t in shared if i is None) == sorted(t for i, t in separate.items() if i >= 1000)
    assert 0 < sum(i is None for i, _ in shared) < 6
