"""Quality rules and chat formatting: brute force on odd inputs; the SQL covers the given tables."""

import hashlib
import re
from collections import Counter

from odd import ODD
from pyspark.sql import functions as F

from linkfold.llm import chat, rules


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rule(docs, prose):
    texts = [*ODD, "a b c a b c d", "#x $y\n#x $y", *[prose(60, k) for k in range(5)], " ".join([prose(60, 9)] * 3)]
    frame = docs(texts, [*range(len(texts) - 1), None])
    rows = {r["doc_id"]: r for r in rules.filter_verdicts(frame).collect()}
    assert len(rows) == len(texts)
    for i, text in zip([*range(len(texts) - 1), None], texts):
        r, want = rows[i], _counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert rules.filter_verdicts(docs([])).count() == 0


def test_thresholds_follow_their_source(docs, prose):
    """Symbols that are usual in one source fail in another; null groups are groups."""
    marked = lambda k: prose(60, k) + " " + "# " * 30
    plain = docs([prose(60, k) for k in range(250)] + [marked(999)], source="plain")
    usual = docs([marked(k) for k in range(250)], range(1000, 1250), source="marked")
    none = docs([prose(60, k) for k in range(5)], range(2000, 2005), lang=None, source=None)
    kept = {r["doc_id"]: r["kept"] for r in rules.filter_verdicts(plain.unionByName(usual).unionByName(none)).collect()}
    assert len(kept) == 506 and not kept[250]
    assert sum(kept[i] for i in range(250)) >= 245 and sum(kept[i] for i in range(1000, 1250)) >= 245


def test_sketches_merge_in_any_order(docs, prose):
    parts = [rules._ratios(rules.measure(docs([prose(50 + k, k) for k in range(a, a + 30)]))) for a in (0, 30)]
    one = {tuple(r) for r in rules.sketches(parts[0].unionByName(parts[1])).collect()}
    summed = Counter()
    for p in parts:
        for *k, n in rules.sketches(p).collect():
            summed[tuple(k)] += n
    assert one == {(*k, n) for k, n in summed.items()}


SAYS = "conv_id long, turn long, role string, text string, tokens string, block string"
HARD = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "<\\|end|>", "<\\\\/s> [\\INST]", "a\\b%0A%25", "<<SYS>>x<</SYS>>", "", None]


def _convs(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", h) for k, h in enumerate(HARD * 2)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "long " * 900), (2, 3, "user", "and?"), (2, 4, "assistant", "yes"), (2, 5, "system", "late")]
    rows += [(3, 0, "system", "alone")]
    rows += [(4, 7, "a%\nb", "role"), (4, None, None, None), (4, 7, "a%\nb", "role"), (4, -2, "assistant", "x")]
    rows += [(5, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * 20) for k in range(1500)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r")]
    return [(*r, "x", "x") for r in rows], spark.createDataFrame([(*r, "x", "x") for r in rows], SAYS)


def test_read_back_equals_the_turns(spark):
    rows, frame = _convs(spark)
    got = {r["conv_id"]: r for r in chat.read_back(chat.windows(frame)).collect()}
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns) and g["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0


def test_windows_keep_to_the_budget(spark):
    _, frame = _convs(spark)
    p = chat.Params(budget=400, history=100)
    rows = chat.windows(frame, p).collect()
    for r in rows:
        assert r["n_tokens"] <= p.budget or r["n_turns"] - r["n_repeated"] == 1
        assert r["text"].count(chat.TURN) == r["n_turns"]
    two = sorted((r for r in rows if r["conv_id"] == 2), key=lambda r: r["first_place"])
    assert len(two) > 1 and all(r["text"].startswith("<|turn|>system\nbe kind<|end|>") for r in two)
    assert sum(len(r["loss"]) for r in rows if r["conv_id"] == 5) == 750
    many = [r for r in rows if r["conv_id"] == 5 and r["first_place"] > 0]
    assert any(r["n_repeated"] > 0 for r in many)


def test_escapes_are_reversible(spark):
    frame = spark.createDataFrame([(h or "",) for h in HARD], "t string")
    back = frame.select("t", chat.unescaped(chat.escaped(F.col("t"))).alias("back"), chat.escaped(F.col("t")).alias("e"), chat.role_of(chat._role(F.col("t"))).alias("role"))
    for r in back.collect():
        assert r["back"] == r["t"] and r["role"] == r["t"] and not re.search(r"</?s>|\[/?INST\]|<\|end\|>", r["e"])
