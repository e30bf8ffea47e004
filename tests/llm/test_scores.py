"""Toxicity and URL verdicts."""

import re

import numpy as np

from tessera.llm import queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


def test_decoder_restores_disguises():
    counts = toxicity.count_trigrams(["the idiot and the clown said stupid things to some idiot"] * 50)
    model = toxicity.CharModel(counts)
    for text, word in (("an 1d10t here", "idiot"), ("so s-t-u-p-i-d", "stupid"), ("i d i o t", "idiot"), ("cl0000wn", "clown"), ("$tup!d", "stupid")):
        assert any(w.startswith(word) for w in toxicity.restored_words(text, model)), text
    assert toxicity.restored_words("", model) == set()


def test_toxicity_query(spark, awkward_df, empty_df):
    got = {r["doc_id"]: r for r in queries.queries()["op5_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(awkward_df, none).collect()} == {toxicity.BASE}
    assert toxicity.drop_toxic(awkward_df, none).columns == awkward_df.columns
    assert toxicity.toxicity_scores(empty_df, none).count() == 0


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.COM", "http://a.com/", "https://www.Example.com/en/1?x#y", "https://example.com/en/", "https://com/x", "x://b.net/es/1", "x://b.net/fr", "x://notcom/", "x://b.net?q=/es/"]
    df = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    for pairs, got in ((list(enumerate(urls)), url_filter.judge_urls(df).collect()), ([(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()], queries.queries()["op7_url_filter"](spark, SF).collect())):
        want = {i: plain_rule(u) for i, u in pairs}
        assert len(got) == len(pairs)
        for r in got:
            host, path, (rule, verdict) = want[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict or rule is None
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    pages = [(1, "x://bad.net/es/1", ""), (2, "x://near.org/1", '<a href="http://bad.net/es/1">'), (3, "x://good.com/", '<a href="//fine.org/">'), (4, "x://fine.org/2", ""), (5, "x://far.org/", "<a href='http://near.org/'>"), (6, "x://alone.org/", '<a href="/in">')]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_odd_pieces_match_their_definition_and_take_linear_time():
    import random
    import re
    import time

    from tessera.llm.toxicity import looks_odd

    plain = re.compile(r"[^\W\d_].*[0-9@$!|+(€£¡*._\-].*[^\W\d_]|[0-9@$!|+€£¡*].*[^\W\d_]{2}|[^\W\d_]{2}.*[0-9@$]|([^\W\d_])\1\1")
    dice = random.Random(3)
    for _ in range(20_000):
        piece = "".join(dice.choice("aab3@.!_-é(x") for _ in range(dice.randint(1, 7)))
        assert looks_odd(piece) == bool(plain.search(piece)), piece
    began = time.perf_counter()
    looks_odd("ab" * 500_000)
    assert time.perf_counter() - began < 5


def test_shares_of_evidence_do_not_depend_on_the_sample(spark, monkeypatch):
    """A word in all toxic and 1 of 100 clean documents, one of which is sampled: a third of its documents are clean."""
    dice = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + c) for c in dice.integers(0, 26, 6)) for _ in range(3000)]
    words = [" ".join(dice.choice(vocabulary, 12)) for _ in range(2040)]
    toxic = [i % 51 == 0 for i in range(len(words))]
    rows = [(i, f"grumble {w}" if toxic[i] or i % 102 == 23 else w) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.corpus_model(docs)
    whole = toxicity.fit(docs, labels, model)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 100)
    few = toxicity.fit(docs, labels, model)
    assert max(whole.get("grumble", 0), few.get("grumble", 0)) < toxicity.THRESHOLD


def test_doubled_letters_and_words_of_one_letter_and_signs_are_decoded():
    counts = toxicity.count_trigrams(["the moron and the idiot said stupid shit to an ass of some idiot and moron"] * 50)
    model = toxicity.CharModel(counts)
    for text, word in (("so stuupid", "stupid"), ("a mooron here", "moron"), ("that 5h1+ again", "shit"), ("1d1o+", "idiot"), ("an a$$", "ass"), ("an ass", "ass"), ("so ѕtυріd", "stupid"), ("mоrоn", "moron")):
        assert word in toxicity.restored_words(text, model), text


def test_distrust_equals_plain_page_rank(spark):
    """A graph with hubs, chains and rings: shares of distrust equal those of plain iterations without an end."""
    dice = np.random.default_rng(9)
    hosts = [f"h{i}.org" for i in range(60)] + [f"good{i}.com" for i in range(5)] + [f"bad{i}.net" for i in range(5)]
    n, pages = len(hosts), []
    weight = np.zeros((n, n))
    for i in range(n):
        links = [0] * 3 + dice.integers(0, n, 3).tolist() if i < 40 else [(i + 1) % n, 0]
        links = [j for j in links if j != i]
        for j in links:
            weight[i, j] += 1
        path = "/es/1" if hosts[i].startswith("bad") else "/"
        pages.append((i, f"http://{hosts[i]}{path}", "".join(f'<a href="https://{hosts[j].upper()}/x?y">' if k % 2 else f"<img src='//{hosts[j]}/i.png'>" for k, j in enumerate(links))))

    def ranks(w, seeds):
        share = w / np.maximum(w.sum(1, keepdims=True), 1)
        start = np.zeros(n)
        start[seeds] = 1 / len(seeds)
        r = start
        for _ in range(300):
            r = 0.15 * start + 0.85 * r @ share
        return r

    good, bad = ranks(weight, list(range(60, 65))), ranks(weight.T, list(range(65, 70)))
    want = bad / np.maximum(good + bad, 1e-300)
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert max(abs(got[i]["distrust"] - want[i]) for i in range(n)) < 0.02
    sure = [i for i in range(60) if abs(want[i] - 0.5) > 0.02]
    assert len(sure) > 50 and 5 < sum(want[i] > 0.5 for i in sure) < 55
    assert all(got[i]["verdict"] == ("block" if want[i] > 0.5 else "allow") for i in sure)


def test_scores_of_a_task_equal_those_of_each_text_alone():
    """What a task remembers changes nothing; a text's score is that of its restored words."""
    model = toxicity.CharModel(toxicity.count_trigrams(["the idiot and the moron said stupid things to an ass"] * 50))
    evidence = {"idio": 0.9, "moron": 0.8, "ass": 0.3, "stup": 0.95}
    texts = ["an 1d10t", "an 1d10t and a m o r o n", "", "nothing here", "ass ass a$$ stuupid", "idiots, idiotic IDIOT", "x " * 1000 + "i-d-i-o-t"]
    memo = {}
    for t in texts * 2:
        words = toxicity.restored_words(t, model)
        assert toxicity.score_text(t, model, evidence, memo) == toxicity.combined([e for w in words if (e := toxicity.word_evidence(w, evidence))])


def test_spared_decodings_have_no_evidence():
    """The cheap test before a decoding changes no score: every piece that it spares decodes to words without evidence."""
    import random

    from tessera.llm import toxicity as tx

    model = tx.CharModel(tx.count_trigrams(["balloon hello letter address summer apple bookkeeper gréén ballon"] * 50))
    dice = random.Random(8)
    signs = "aabbeello" + "éü-._'" + "1@$*0" + "аж"
    pieces = ["".join(dice.choice(signs) for _ in range(dice.randint(1, 9))) for _ in range(4000)]
    pieces += ["hello", "helllo", "he-llo", "HELLO".lower(), "béllo", "balloon!", "(hello)"]
    spared = 0
    for _ in range(3):
        evidence = {w: 0.9 for p in dice.sample(pieces, 150) for w in [model.decode(p)[:dice.randint(2, 7)]] if len(w) >= 2}
        reach = {tx.squeezed(w) for w in evidence}
        for p in pieces:
            spared += tx.may_hide(p) and not tx.may_reach(p, reach)
            assert tx.score_text(p, model, evidence, {}, reach) == tx.score_text(p, model, evidence, {})
    assert spared > 50
