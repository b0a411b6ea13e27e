import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import rows_of
from tillrec.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return {"email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]}


@pytest.mark.parametrize("alphabet", ["a.@-1 ", "+1 ()-.23", "0123456789 -", ".12", "a@b.cé"])
def test_base_equals_plain_patterns(alphabet):
    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=alphabet, max_size=45))
    def run(text):
        assert pii.plain(text) == brute(text)
    run()


@pytest.mark.parametrize("text, kind, hidden", [
    ("write to john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("mail john [at] mail [dot] example [dot] org.", "email", "john [at] mail [dot] example [dot] org"),
    ("john at example dot com", "email", "john at example dot com"),
    ("is john_at_example_dot_com here", "email", "john_at_example_dot_com"),
    ("jоhn@exаmple.com mail", "email", "jоhn@exаmple.com"),
    ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
    ("é ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("card 4111 1111 l111 1111 x", "card", "4111 1111 l111 1111"),
    ("pay " + "four" + " one" * 15 + " now", "card", "four" + " one" * 15),
    ("call plus one five five five one two three four five six seven ok", "phone",
     "plus one five five five one two three four five six seven"),
    ("ruf plus vier neun null eins fünf eins zwei drei vier fünf sechs an", "phone",
     "plus vier neun null eins fünf eins zwei drei vier fünf sechs"),
    ("call +1 (555) 55O-12l4 now", "phone", "+1 (555) 55O-12l4"),
    ("mail jane.roe at example.com today", "email", "jane.roe at example.com"),
    ("mail jane @ example . com today", "email", "jane @ example . com"),
    ("mail jane(arroba)ejemplo(punto)es hoy", "email", "jane(arroba)ejemplo(punto)es"),
    ("is 1 (dot) 2 (dot) 3 (dot) 4 up", "ip", "1 (dot) 2 (dot) 3 (dot) 4"),
])
def test_disguises_are_found_in_source_characters(text, kind, hidden):
    base, every = pii.find(text)
    assert base[kind] == [] and [text[a:b] for a, b in every[kind]] == [hidden]


@pytest.mark.parametrize("text", [
    "look at the dot on it", "look at example.com", "meet me @ noon. Then we go", "un deux trois quatre cinq six",
    "of it at it.is it", "one two three four five six seven eight nine ten", "we met at noon (at) the park",
    "see example (dot) com", "Привет, как дела", "at 192 dot 168", "room 101 l and O", "a | b | c"])
def test_clean_texts_stay_clean(text):
    assert not any(pii.find(text)[1].values())


def test_base_spans_stay_beside_added_ones():
    text = "a@b.co and c (at) d (dot) org and 1.2.3.4"
    base, every = pii.find(text)
    assert base["email"] == [(0, 6)] and every["email"][0] == (0, 6) and len(every["email"]) == 2
    assert base["ip"] == every["ip"]


def test_query_rows_and_edges(make_docs):
    empty = hashlib.sha256(b"").hexdigest()
    long = "x" * 300_000 + " a@b.co " + "1" * 100_000
    docs = make_docs([(1, "é a@b.co"), (2, None), (2, ""), (None, "+1 (555) 555-5555"), (5, long)])
    got = {(r["doc_id"], r["spans"]): r for r in pii.personal_data(docs).collect()}
    assert got[(1, "email:2:8")]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest()
    assert got[(2, "")]["base_sha256"] == empty and got[(None, "phone:0:17")]["n_phone"] == 1
    assert got[(5, "email:300001:300007")]["n_email"] == 1
    assert len(rows_of(pii.personal_data(docs), "doc_id")) == 5
    assert pii.personal_data(make_docs([])).collect() == []


@pytest.mark.parametrize("text, kind, hidden", [
    ("ping one zero dot zero dot zero dot one now", "ip", "one zero dot zero dot zero dot one"),
    ("ping one two seven dot zero dot zero dot one now", "ip", "one two seven dot zero dot zero dot one"),
    ("ping 192 dot 168 dot 0 dot 1 now", "ip", "192 dot 168 dot 0 dot 1"),
    ("in 2024 192 dot 168 dot 0 dot 1 was up", "ip", "192 dot 168 dot 0 dot 1"),
    ("ping 192.168 dot zero dot double one now", "ip", "192.168 dot zero dot double one"),
    ("ping 192.168.zero.one now", "ip", "192.168.zero.one"),
    ("call +49 151 two three four five six seven now", "phone", "+49 151 two three four five six seven"),
    ("call +49 (151) two three four 567 now", "phone", "+49 (151) two three four 567"),
    ("call plus 49 151 234567 now", "phone", "plus 49 151 234567"),
    ("pay 4111 1111 1111 one one one one now", "card", "4111 1111 1111 one one one one"),
    ("pay 4111-1111-1111-one one one one now", "card", "4111-1111-1111-one one one one"),
])
def test_short_spelled_runs_count_with_the_digits_beside_them(text, kind, hidden):
    base, every = pii.find(text)
    assert base[kind] == [] and [text[a:b] for a, b in every[kind]] == [hidden]


@pytest.mark.parametrize("text", [
    "two plus two", "version one dot two dot three", "one two 300 dot 4 dot 5", "one dot two dot three dot 256",
    "add one two three 4 5 6", "+1 one two", "4111 1111 1111 one one one two", "item one 1.5 dot two"])
def test_short_spelled_runs_without_a_number_stay_clean(text):
    assert not any(pii.find(text)[1].values())


def test_long_runs_of_spelled_and_plain_digits_take_linear_time():
    text = "one two 3 dot " * 20_000 + "1 " * 50_000 + "one " + "(2) " * 50_000
    assert pii.find(text)[1]["email"] == []


@pytest.mark.parametrize("hidden", [
    "ann at host dot co dot uk", "ann at my-site dot com", "ann at host dot nl", "ann at host dot dev", "ann at host dot in",
    "ann.lee at host.co.uk", "ann @ my-site . com . au", "ann @ host.jp", "ann_at_my-site_dot_com_dot_br",
    "ann-at-my-site-dot-co-dot-uk", "ann at a dot b dot c dot d dot e dot f dot g dot org", "ann at the dot com",
    "ann at host dot xn--p1ai",
])
def test_whole_spoken_and_spaced_hosts_are_found(hidden):
    text = f"mail {hidden} today"
    base, every = pii.find(text)
    assert base["email"] == [] and [text[a:b] for a, b in every["email"]] == [hidden]


@pytest.mark.parametrize("text", ["look at the dot in the middle", "look at a dot is it", "ann at host dot nowhereland",
                                  "ann at host- dot x", "it was 5 at the bank. In May"])
def test_prose_is_no_host(text):
    assert not pii.find(text)[1]["email"]


def test_a_host_ends_at_the_last_known_ending():
    text = "write ann at host dot com dot whatsoever else"
    assert [text[a:b] for a, b in pii.find(text)[1]["email"]] == ["ann at host dot com"]
