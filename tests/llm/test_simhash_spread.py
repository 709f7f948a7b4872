"""Many components are joined in salted parts, few are broadcast; the rows are the same."""

from driftwell.llm import simhash as S


def test_salted_parts_give_the_same(docs, monkeypatch):
    show = lambda df: sorted(map(repr, df.collect()))
    few = show(S.near_duplicates(docs))
    monkeypatch.setattr(S, "SENT", 0)
    monkeypatch.setattr(S, "SALTS", 3)
    assert show(S.near_duplicates(docs)) == few and len(few) == docs.count()
