"""Short needles are known by all their characters, so texts that only share the first one are no candidates."""

from leafmill.operators import needles


def test_short_needles_meet_only_texts_that_hold_them():
    for needle, other in (("abc", "axx bca cab"), ("ab", "ax xb ba")):
        k, h = needles.needle_key(needle)
        assert h in needles.text_keys(f"x {needle} y", k).tolist()
        assert h not in needles.text_keys(other, k).tolist()
