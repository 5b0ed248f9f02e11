"""Notices whose first, last or early words are changed."""

import pytest

from vibrata.llm import licenses

FILLER = "the quiet river runs past seven old mills and nobody counts them any more " * 20
LONG = [k for k, t in licenses.TEMPLATES.items() if len(licenses.words(t.encode())) >= 30]


@pytest.mark.parametrize("name", LONG)
@pytest.mark.parametrize("changed", [[0], [-1], [0, 1, 2], [0, 8, 16], [0, -1]])
@pytest.mark.parametrize("words_before", [0, 30, 61])
def test_changed_words_anywhere(name, changed, words_before):
    words = licenses.TEMPLATES[name].split()
    for k in changed:
        words[k] = "qq"
    text = " ".join(FILLER.split()[:words_before] + words) + " " + FILLER
    rows = [r for r in licenses.Scanner(licenses.TEMPLATES).scan(text.encode()) if r[0] == name]
    assert len(rows) == 1 and 0 < rows[0][5] <= 0.1 * rows[0][4]


def test_a_notice_with_another_programs_name():
    text = licenses.TEMPLATES["GPL-3.0-or-later"].replace("This program", "Foobar")
    rows = licenses.Scanner(licenses.TEMPLATES).scan((FILLER + text + " " + FILLER).encode())
    assert [(r[0], r[5]) for r in rows] == [("GPL-3.0-or-later", 2)]


def altered():
    """Notices with each word changed in turn, and with as many words changed as may be, anchors first."""
    for name, text in licenses.TEMPLATES.items():
        own = text.split()
        most = int(licenses.DIFFERENCE * len(licenses.words(text.encode())))
        if most:
            for k in range(len(own)):
                yield name, [*own[:k], "qqq", *own[k + 1 :]]
        known = licenses.anchors(licenses.TEMPLATES)
        holding = [k for k, w in enumerate(own) if any(a in w.lower() for a in known)]
        for some in (holding[:most], holding[-most:] if most else []):
            yield name, [w if k not in some else "qqq" for k, w in enumerate(own)]


def test_no_changed_words_hide_a_notice_that_the_rule_accepts():
    scanner, missed, accepted = licenses.Scanner(licenses.TEMPLATES), [], 0
    for name, own in altered():
        text = (FILLER + " ".join(own) + " " + FILLER).encode()
        block = licenses.words(text)
        if scanner.confirmed(name, block, 0, len(block)):
            accepted += 1
            if not scanner.scan(text):
                missed.append((name, own))
    assert accepted > 500 and not missed


def test_every_template_keeps_an_anchor_under_any_changes_that_are_allowed():
    known = licenses.anchors(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        own = [w.decode() for w, _, _ in licenses.words(text.encode())]
        assert sum(any(a in w for a in known) for w in own) > int(licenses.DIFFERENCE * len(own)), name


def test_a_misspelt_license(spark):
    from tests.llm.helpers import documents

    text = licenses.TEMPLATES["MPL-2.0"].replace("Public License", "Public Lisence")
    rows = [(1, text), (1, text), (2, licenses.TEMPLATES["Unlicense"].replace("public domain", "open domain")), (3, FILLER), (4, None)]
    found = licenses.license_scan(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "MPL-2.0"), (1, "MPL-2.0"), (2, "Unlicense")]
