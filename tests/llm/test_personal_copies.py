"""Copies of one number or address far from its base span."""
import collections

from marksheet.llm import pii


def trained():
    train = ["call +1 412 555 2485 now", "mail ann.lee@mail.org or 10.1.2.3", "pay 4485275742308327 in 2020", "see 12 and 3"] * 50
    sums = collections.Counter()
    for text in train:
        pii.count_factors(text, pii.base_spans(text), sums)
    return pii.potentials(sums)


def test_a_hundred_copies_around_one_base_span():
    model = trained()
    copies = "412-555-2485 and then " * 50
    text = copies + "+1 412 555 2485 or " + copies + "room 12"
    base = pii.base_spans(text)
    added, settled = pii.infer(text, base, model)
    assert settled and len(base) == 1
    assert [(text[s:e], pii.KINDS[k]) for s, k, e in added] == [("412-555-2485", "phone")] * 100


def test_skip_edges_are_linear_and_lead_to_base_spans():
    text = "412-555-2485 x " * 30 + "+1 412 555 2485 x " * 2 + "998-555-2486 y " * 5
    field = pii.Field(text, pii.base_spans(text))
    assert len(field.skip) == 30 + 1 + 4
    assert sum(field.nodes[a][2] >= 0 for a, _ in field.skip) == 31


def test_messages_that_do_not_settle_are_reported(monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 1)
    text = "412-555-2485 or +1 412 555 2485 or 412-555-2485 10 11 12"
    assert not pii.infer(text, pii.base_spans(text), trained())[1]
