"""Long labelled rows neither thin out a language's sample nor leave it without a model."""

from quire.llm import language_id
from tests.llm.conftest import rows_of
from tests.llm.test_corpus_ops import is_held_out


def test_sample_of_languages_with_long_rows(frame, monkeypatch):
    monkeypatch.setattr(language_id, "LONGEST", 50)
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    texts = ["short row of one " * 2] * 15 + ["one row of short " * 9] * 285 + ["vsi dve zelo dolgi " * 9] * 15
    rows = rows_of(texts, langs=["one"] * 300 + ["two"] * 15)
    sample = language_id.training_sample(frame(rows))
    assert sample["one"] == [r[1] for r in rows[:15] if not is_held_out(r[0])]
    assert sample["two"] == [r[1][:50] for r in rows[300:] if not is_held_out(r[0])]
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(rows)).collect()}
    assert all(found[r[0]] == r[2] for r in rows)
