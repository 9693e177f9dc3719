import re
from collections import Counter

from tremor.llm import repetition as rep

WORD = re.compile("[^\x20\x09-\x0D]+")


def inside(words, n):
    """Positions inside n-grams that occur twice or more."""
    grams = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i:i + n])] > 1 for j in range(n)}


def later(words, n):
    """Positions inside n-grams that start at an earlier position too."""
    seen, found = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i:i + n])
        found |= set(range(i, i + n)) if gram in seen else set()
        seen.add(gram)
    return found


def frame(lines):
    """Positions of the words of the last copy of the opening lines, if it is short."""
    sizes = [len(WORD.findall(x)) for x in lines]
    at = max((j for j in range(1, len(lines)) if lines[j] == lines[0]), default=len(lines))
    k = max((k for k in range(1, at + 1) if at + k <= len(lines) and lines[at:at + k] == lines[:k]), default=0)
    found = range(sum(sizes[:at]), sum(sizes[:at + k]))
    return set(found) if len(found) <= rep.FRAME_WORDS else set()


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    chars = sum(map(len, w))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += len("".join(WORD.findall(x)))
        seen.add(x)
    repeat = len(inside(w, 3))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    closing = frame(lines)
    bad = dup_chars - sum(len(w[i]) for i in closing) > rep.LINE_LIMIT * max(chars, 1)
    for n, limit in rep.TOP_LIMITS.items():
        grams = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        top = max(grams.values(), default=0)
        if top > 1:
            most = max(top * sum(map(len, g)) for g, c in grams.items() if c == top)
            bad |= most > limit * max(chars, 1)
    for n, limit in rep.DUP_LIMITS.items():
        bad |= sum(len(w[i]) for i in later(w, n) if i not in closing) > limit * max(chars, 1)
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, dup_chars, failed, not failed and not bad)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "base_failed", "kept")


def test_all_documents_equal_brute_force(documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = rep.repetition(documents, batch_chars=5000).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == slow(text[r["doc_id"]])


def test_repeated_texts_are_rejected_and_clean_ones_kept(spark):
    prose = " ".join(f"word{k * 7919 % 1009}" for k in range(300))
    line = "this very line is repeated over and over again\n"
    long_run = " ".join(f"w{k}" for k in range(60))
    cases = [(1, prose, True), (2, prose + "\n" + line * 40, False), (3, line * 200, False),
             (4, long_run + "\n" + prose[:900] + "\n" + long_run, False),
             (5, "header line of a site\n" + prose + "\nheader line of a site", True), (6, "too short", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in rep.repetition(df).collect()}
    assert got == {k: kept for k, _, kept in cases}


def planted(share, first, n=400):
    """``n`` words of which this share lies in later copies of passages of 12 to 25 words."""
    words, copies = [f"u{first}x{k}" for k in range(n - round(share * n))], round(share * n)
    out, at = list(words), 0
    while copies:
        use = min(copies, 25 if copies > 37 or copies <= 25 else copies - 12)
        out += words[at:at + use]
        copies -= use
        at += use
    return " ".join(out)


def test_limits_act_at_the_stated_coverage(spark):
    """Later copies of 5 % leave a text alone; 15, 25 and 35 % do not. The repeated base
    windows stay under their own limit until 25 %, so the verdict is the method's."""
    cases = [(1, planted(0.05, 1), True), (2, planted(0.15, 2), False), (3, planted(0.25, 3), False), (4, planted(0.35, 4), False)]
    rows = {r["doc_id"]: r for r in rep.repetition(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert {k: rows[k]["kept"] for k in rows} == {k: kept for k, _, kept in cases}
    assert [rows[k]["base_failed"] for k in (1, 2, 3)] == [False] * 3


def test_short_frames_do_not_count(spark):
    body = "\n".join(" ".join(f"v{k}x{j}" for j in range(12)) for k in range(5))
    header = "home products about this site\ncontact us\n"
    long = "\n".join(" ".join(f"h{k}x{j}" for j in range(9)) for k in range(3)) + "\n"
    df = spark.createDataFrame([(1, header + body + "\n" + header), (2, long + body + "\n" + long),
                                (3, header + body + "\n" + header * 4), (4, header + body + "\n" + header + "a last line")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in rep.repetition(df).collect()}
    assert {k: (r["kept"], r["frame_chars"] > 0) for k, r in rows.items()} == {1: (True, True), 2: (False, False), 3: (False, True), 4: (True, True)}


def test_hard_rows(hard, empty):
    rows = rep.repetition(hard).collect()
    want = sorted(str((r["doc_id"], *slow(r["text"]))) for r in hard.collect())
    assert sorted(str((r["doc_id"], *(r[c] for c in COLUMNS))) for r in rows) == want
    assert rep.repetition(empty).collect() == []
