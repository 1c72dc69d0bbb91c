import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import pii, quality_rules

from .conftest import make_docs, prose


def brute_quality(text, limits=quality_rules.Rules()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def covered(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = set()
        for i in range(len(words) - n + 1):
            if grams[tuple(words[i : i + n])] > 1:
                hit |= set(range(i, i + n))
        return hit

    seen, again, dup_chars, all_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            all_chars += len(line)
            again += line in seen
            dup_chars += len(line) * (line in seen)
            seen.add(line)
    repeat = len(covered(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    bad = dup_chars / max(1, all_chars) > limits.max_line_share
    for n, most in limits.gram_shares:
        bad |= sum(len(words[i]) for i in covered(n)) / max(1, chars) > most
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), again, repeat, failed, not failed and not bad


def test_quality_against_brute_force(spark, odd_docs, odd_texts):
    rnd = random.Random(3)
    more = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(200))) for _ in range(60)]
    more += ["\n".join(rnd.choice(["x y z", " ", "", "q r", prose(rnd, 20)]) for _ in range(rnd.randrange(30))) for _ in range(60)]
    for docs, texts in ((odd_docs, odd_texts), (make_docs(spark, more), more)):
        got = quality_rules.quality_table(docs).collect()
        assert len(got) == len(texts)
        want = Counter((r["doc_id"], *brute_quality(r["text"])) for r in docs.select("doc_id", "text").collect())
        assert Counter(tuple(r)[:8] for r in got) == want


def test_quality_filter_keeps_columns(odd_docs, odd_texts, no_docs):
    kept = quality_rules.keep_good(odd_docs)
    assert kept.schema == odd_docs.schema
    assert Counter(r["text"] for r in kept.collect()) == Counter(t for t in odd_texts if brute_quality(t)[-1])
    assert quality_rules.keep_good(no_docs).count() == quality_rules.quality_table(no_docs).count() == 0


def brute_base(text):
    """The four patterns as they stand."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        yield "email", *m.span()
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            yield "card", *m.span()
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            yield "phone", *m.span()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+%0123456789 ()é٣\n", max_size=80))
def test_base_spans_are_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(brute_base(text))


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("my IBAN is GB82 WEST 1234 5698 7654 32 thanks") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    high, low = pii.find("visa card 4111 1111 1111 1111")[0], pii.find("#4111 1111 1111 1111")[0]
    assert high[3] > low[3]
    assert pii.masked("mail a.b@c.de or +1 (555) 123-4567!") == "mail <EMAIL> or <PHONE>!"


def test_long_runs_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "a." * 100_000 + "@b", "1." * 100_000, "+1" + "-" * 200_000, "AB12" * 50_000):
        pii.find(text)


def test_pii_table(spark, odd_docs, odd_texts, no_docs):
    texts = ["a@b.co 10.0.0.1 10.0.0.300 4111111111111111 +49 (30) 1234567", None, "", "é a@b.c.d é"]
    rows = {r["doc_id"]: r for r in pii.pii_table(make_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = sorted(brute_base(t or ""), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert pii.pii_table(odd_docs).count() == len(odd_texts) and pii.pii_table(no_docs).count() == 0
    masked = pii.mask(odd_docs)
    assert masked.schema == odd_docs.schema and sum(r["text"] is None for r in masked.collect()) == 2
