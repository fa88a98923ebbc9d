"""Disguises in texts that hold nothing else."""

import pytest

from tidemark.llm import pii


@pytest.mark.parametrize("text,kind", [
    ("write to jane.doe at example.com today", "email"), ("write to jane.doe\nAT\nexample.com", "email"),
    ("192.\n168.\n1.\n20", "ip"), ("192\t.168\t.1\t.20", "ip"), ("one one one dot one one dot one dot one", "ip"),
])
def test_found_alone(text, kind):
    base, every = pii.find(text)
    added = [pii.KINDS[k] for s, k, e in every if (s, k, e) not in base]
    assert any(kind in k for k in added), every
