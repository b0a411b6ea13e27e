import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from tests.llm.conftest import rows_of
from tillrec.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "This is a plain sentence of nine words here. "


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t|#é\x1c .", max_size=60))
def test_counts_equal_brute_force(text):
    j = quality.judge(text)
    assert (j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words) == brute(text)


def test_each_line_rule():
    assert quality.line_fails("Home | News | About | Contact") == "navigation"
    assert quality.line_fails("word### word$$$ word%%%.") == "symbols"
    assert quality.line_fails("BUY!! NOW!! CHEAP!!") == "shouting"
    assert quality.line_fails("We use cookies, see our Cookie Policy.") == "boilerplate"
    assert quality.line_fails("a heading without an end") == "unterminated"
    assert quality.line_fails("One sentence. And an open tail") is None
    assert quality.line_fails("He said \"yes.\"") is None
    assert quality.line_fails(" \t ") is None


def test_document_losing_too_much_goes_and_others_are_cleaned(make_docs):
    good = " ".join(f"word{i} is a{i} b{i}." for i in range(30))
    bad_line = "Home | News | About"
    lost = "\n".join([good] + [" | ".join(f"item{i}x{k}" for i in range(40)) for k in range(6)])
    docs = make_docs([(1, good), (2, good + "\n" + bad_line), (3, lost), (4, None), (5, ""), (6, "short text."),
                      (1, good), (None, good)])
    verdict = {r["doc_id"]: r for r in quality.line_verdicts(docs).collect()}
    assert verdict[1]["kept"] and verdict[2]["kept"] and not verdict[3]["kept"] and not verdict[3]["base_failed"]
    assert all(verdict[k]["base_failed"] and not verdict[k]["kept"] for k in (4, 5, 6))
    cleaned = quality.clean_documents(docs)
    assert cleaned.columns == docs.columns
    assert sorted(rows_of(cleaned, "doc_id", "text", "n_chars"), key=str) == sorted(
        [(1, good, len(good))] * 2 + [(2, good, len(good)), (None, good, len(good))], key=str)


def test_very_long_text_and_empty_table(make_docs):
    long = (PROSE * 30 + "\n") * 300
    assert quality.line_verdicts(make_docs([(1, long)])).first()["n_words"] == 9 * 30 * 300
    assert quality.line_verdicts(make_docs([])).collect() == []
    assert quality.clean_documents(make_docs([])).collect() == []


def test_sentences_end_as_their_script_ends_them():
    lines = lambda word, end: "\n".join(" ".join(f"{word}{k}{word}{j}" for j in range(6)) + end for k in range(12))
    hindi, thai, arabic = lines("शब्द", " शब्द।"), lines("คำ", " คำ"), lines("كلمة", " كلمة؟")
    for text in (hindi, thai, arabic):
        assert quality.judge(text).kept
    assert not quality.judge(lines("word", " word")).kept
