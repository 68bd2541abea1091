import re
from collections import Counter

from strandline.llm import quality_rules as q
from strandline.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"


def measure(text):
    text = text or ""
    w = re.findall(WORD, text)
    at = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if at[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measurements_against_brute_force(make_docs, hard_pairs):
    extra = [(900, "a b c a b c x y z"), (901, "a a a a"), (902, "l1\n l1\nl1\n\n\nl1"), (903, "# * $\n# * $"), (904, "SHOUT " * 60), (905, "😀 😀 😀 😀 é")]
    pairs = hard_pairs + extra
    rows = q.judged(make_docs(pairs)).collect()
    want = []
    for i, t in pairs:
        n, c, s, d, r = measure(t)
        want.append((str(i), n, c, s, d, r, n < 50 or 100 * r > 50 * n))
    assert sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in rows) == sorted(want)
    assert all(x.kept == (x.fail_bits & q.mask(q.PRODUCTION) == 0) and not (x.base_failed and x.kept) for x in rows)


def test_ablation_counts(make_docs, hard_pairs):
    rows = materialise(q.ledger(make_docs(hard_pairs)), "ledger")
    bits = [r.fail_bits & q.mask("full-1") for r in rows.collect()]
    for r in q.ablation(rows, "full-1").collect():
        b = q.bit(r.rule)
        assert r.failed == sum(x & b > 0 for x in bits)
        assert r.failed_alone == sum(x == b for x in bits)
        assert r.kept_without == sum(x & ~b == 0 for x in bits)


def test_policies_only_read_bits(make_docs, hard_pairs):
    rows = materialise(q.ledger(make_docs(hard_pairs)), "ledger")
    base, full = (rows.where(q.apply_policy(rows, p)).count() for p in ("base-1", "full-1"))
    assert base >= full


def test_empty_table(make_docs):
    assert q.judged(make_docs([])).count() == 0
