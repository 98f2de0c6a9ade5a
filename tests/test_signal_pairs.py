"""Signals with a log in which each holds and one, little different, in which it does not."""

import pytest

from .signal_pairs import PAIRS, whole_logs


@pytest.mark.parametrize("name", PAIRS)
def test_signal(explained_logs, name):
    for sign, of in zip("+-", PAIRS[name], strict=True):
        for k in range(len(of)):
            r = explained_logs.found[f"{name} {sign}{k}"]
            assert (name in r.signals) is (sign == "+"), (sign, k, r.message, r.obligation, r.signals)


def test_all_logs_are_explained(explained_logs):
    assert whole_logs().keys() <= explained_logs.found.keys()
