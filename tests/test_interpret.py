"""Query parsing and validation, on the driver."""

import pytest

from lumencat.functions import text as T
from lumencat.functions.interpret import Clause, InvalidQuery, StructuredQuery, TextQuery, interpret, parse_clauses


def test_durations_phrases_negations_and_stop_words():
    i = interpret(TextQuery(text='find me a "metal door" hit under 3 seconds over 0.5 secs not rain -wind'))
    assert i.phrases == ["metal door"] and i.terms == ["impact"] and i.excluded == ["rain", "wind"]
    assert (i.min_duration, i.max_duration) == (0.5, 3.0)


def test_a_negation_reaches_one_phrase():
    i = interpret(TextQuery(text='"old gate" not "old gate" "new door"'))
    assert (i.phrases, i.excluded) == (["old gate", "new door"], ["old gate"])
    assert interpret(TextQuery(text='- rain "" \'open')).terms == ["rain"]


def test_minutes_tightest_bound_and_short():
    i = interpret(TextQuery(text="under 2 minutes below 90 seconds", max_duration=100.0))
    assert i.max_duration == 90.0
    assert interpret(TextQuery(text="short rain")).max_duration == 3.0
    assert interpret(TextQuery(text="not short rain")).excluded == ["short"]


def test_apostrophes_are_not_quotes():
    assert interpret(TextQuery(text="dog's bark")).terms == ["dogs", "bark"]
    assert interpret(TextQuery(text="'old gate' open")).phrases == ["old gate"]


@pytest.mark.parametrize("q", [TextQuery(text="x" * 513), TextQuery(limit=501), TextQuery(min_duration=-1.0), TextQuery(text="over 5 seconds under 4 seconds"), TextQuery(max_duration=float("nan"))])
def test_limits(q):
    with pytest.raises(InvalidQuery):
        interpret(q)


def test_clauses():
    clauses, ignored = parse_clauses('rain "old  gate" thun* -loud -- rain "" - x')
    assert clauses == [Clause("rain", "term"), Clause("old gate", "phrase"), Clause("thun", "prefix"), Clause("loud", "term", True), Clause("x", "term")]
    assert ignored == ["--", "-"]


def test_cjk_characters_are_tokens():
    assert Clause("長い名前", "term").tokens == ["長", "い", "名", "前"]


@pytest.mark.parametrize("q", [StructuredQuery(min_rating=4, max_rating=2), StructuredQuery(tags=["a_b"], exclude_tags=["A b"]), StructuredQuery(rated=False, min_rating=1), StructuredQuery(added_after=5, added_before=5), StructuredQuery(min_width=0), StructuredQuery(fields=("colour",)), StructuredQuery(text="a " * 20 + " ".join(f"w{i}" for i in range(40)))])
def test_contradictions_are_rejected(q):
    with pytest.raises(InvalidQuery):
        q.validated()


@pytest.mark.parametrize(("a", "b", "n"), [("tarin", "train", 1), ("scartch", "scratch", 1), ("train", "rain", 1), ("ca", "abc", 2), ("", "abc", 3), ("same", "same", 0), ("whosh", "whoosh", 1)])
def test_damerau_levenshtein(a, b, n):
    assert T.damerau_levenshtein(a, b) == n
