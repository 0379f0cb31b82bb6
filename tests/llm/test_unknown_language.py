"""Texts that no profile knows."""

from setlist.llm import language_id


def test_texts_of_no_learned_language_go(make_docs):
    labelled = make_docs([(0, "the house and the garden of the old man", "en", "a"), (1, "das Haus und der Garten des alten Mannes", "de", "a")])
    profiles = language_id.learn_profiles(labelled)
    texts = make_docs([(1, "the man", None, "a"), (2, "καλημέρα κόσμε", None, "a"), (3, "你好世界", None, "a"), (4, "der Garten", None, "a"), (5, "42", None, "a")])
    assert sorted(r["doc_id"] for r in language_id.reject_unknown(texts, profiles).collect()) == [1, 4]
