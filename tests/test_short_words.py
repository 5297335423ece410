"""The full stop of a short word ends no sentence: a name that has one is one entity."""

from larkspan.operators import recogniser


def test_names_with_a_full_stop():
    text = "Ask at St. Brann Hospital. Dr. Lee left! Why?"
    got = [[text[a:b] for a, b in s] for s in recogniser.sentences(text)]
    assert got == [["Ask", "at", "St", ".", "Brann", "Hospital", "."], ["Dr", ".", "Lee", "left", "!"], ["Why", "?"]]
    pieces = [{"text": "Ask at ", "kind": None}, {"text": "St. Brann Hospital", "kind": "ORG"}, {"text": ".", "kind": None}]
    org = recogniser.TAGS.index("ORG")
    ((words, tags),) = recogniser.sentences_of(pieces)
    assert tags == [0, 0, org, org, org, org, 0] and words[2:4] == ["St", "."]
