"""Kin licenses get their own names, and none gets another's."""

import pytest

from vibrata.llm import licenses

FILLER = "the quiet river runs past seven old mills and nobody counts them any more " * 6


def found(text):
    return [r[0] for r in licenses.Scanner(licenses.TEMPLATES).scan((FILLER + text + " " + FILLER).encode())]


@pytest.mark.parametrize("name", ["GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"])
@pytest.mark.parametrize("work", ["This program", "This library", "Foobar"])
def test_headers_of_the_gnu_family(name, work):
    text = licenses.TEMPLATES[name]
    assert found(text.replace("This program", work).replace("This library", work)) == [name]


def test_versions_and_families_without_a_template_are_not_named_by_kin():
    assert found(licenses.TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 4")) == []
    assert found(licenses.TEMPLATES["GPL-2.0-only"].replace("GNU General", "GNU Library General")) == []


def test_bsd_clauses():
    three = licenses.TEMPLATES["BSD-3-Clause"]
    assert found(three) == ["BSD-3-Clause"] and found(licenses.TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"]
    assert found(three.replace("the copyright holder", "Foo").replace("Redistributions of", "1. Redistributions of")) == ["BSD-3-Clause"]
    # A third clause of other words is no BSD-2-Clause.
    assert "BSD-2-Clause" not in found(three.split("Neither")[0] + "Neither may anybody hum loudly " + "on any of the old river boats " * 3)


def test_spdx_tags():
    assert found("# SPDX-License-Identifier: MIT OR Apache-2.0\n") == ["MIT OR Apache-2.0"]
