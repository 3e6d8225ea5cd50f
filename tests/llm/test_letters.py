import pytest

from genoloom.llm.langid import has_letter


@pytest.mark.parametrize(("text", "want"), [("² ½", False), ("Ⅷ ⅓ ³", False), ("12 _ -", False), ("", False), ("² é", True), ("中", True), ("ª", True), ("Ⅷx", True)])
def test_letters_are_unicode_letters(text, want):
    assert has_letter(text) is want
