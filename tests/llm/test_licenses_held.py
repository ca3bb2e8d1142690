"""Sixty sentences that were written after the licence model's last change, go through the whole scan, and were judged once."""

from __future__ import annotations

import pytest

from rangeloom.llm import licenses

#: family, sentence. Once the model is changed because of one of these, new ones are needed.
HELD = [
    ("mit", "You can use this plugin freely under the MIT license."),
    ("mit", "The sources of this site are MIT licensed, the logo is not."),
    ("mit", "License :: OSI Approved :: MIT License"),
    ("mit", "Our documentation tool is distributed under the terms of the MIT licence."),
    ("apache-2.0", "All of the code here is made available under the Apache License, Version 2.0."),
    ("apache-2.0", "The connector is Apache 2.0 licensed."),
    ("apache-2.0", "Contributions are accepted under the Apache License 2.0 only."),
    ("apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "It comes with a BSD license, see below."),
    ("bsd", "The kernel modules are released under the 2-clause BSD license."),
    ("bsd", "New BSD License"),
    ("gpl-2.0", "This driver is distributed under the GNU General Public License, version 2."),
    ("gpl-2.0", "The firmware tools are licensed under GPLv2."),
    ("gpl-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ("gpl-3.0", "The game engine is released under the GPLv3."),
    ("gpl-3.0", "You may copy it under the GNU General Public License version 3 or any later version."),
    ("gpl-3.0", "License: GPL-3.0"),
    ("agpl-3.0", "The hosted service runs code under the AGPLv3."),
    ("agpl-3.0", "It is covered by the GNU Affero General Public License."),
    ("lgpl", "The bindings are available under the LGPL."),
    ("lgpl", "Linking is possible since the library is under the GNU Lesser General Public License."),
    ("lgpl", "License: LGPLv3"),
    ("mpl-2.0", "The add-on is published under the Mozilla Public License, version 2.0."),
    ("mpl-2.0", "License: MPL-2.0"),
    ("isc", "This small library is released under the ISC license."),
    ("isc", "ISC-licensed, like its parent project."),
    ("cc-by-4.0", "The photographs are published under CC BY 4.0."),
    ("cc-by-4.0", "Text and figures: Creative Commons Attribution 4.0 International."),
    ("cc-by-sa-4.0", "The wiki's text is available under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "Maps are shared under a Creative Commons Attribution-ShareAlike 4.0 licence."),
    ("cc-by-nc-4.0", "The slides may be used under CC BY-NC 4.0."),
    ("cc-by-nc-nd-4.0", "The article is published under CC BY-NC-ND 4.0."),
    ("cc-by-nc-sa-4.0", "The course is offered under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence."),
    ("cc-by-nd-4.0", "The essay is shared under CC BY-ND 4.0."),
    ("cc0-1.0", "The data set is released under CC0."),
    ("public-domain", "The scans of these maps are in the public domain."),
    ("epl-2.0", "The compiler plugin is licensed under the Eclipse Public License 2.0."),
    ("eupl-1.2", "The portal's code is licensed under the EUPL."),
    ("ofl-1.1", "The typeface is licensed under the SIL Open Font License, Version 1.1."),
    ("all-rights-reserved", "(c) 2019 Example Press. All rights reserved."),
    ("unknown", "This firmware is distributed under the Hypothetical Public License 1.0."),
    ("unknown", "Released under the Acme Community License, version 2.0."),
    ("unknown", "Use is governed by the vendor's commercial license agreement."),
    ("unknown", "The code has never been released under the GPL."),
    ("unknown", "It is no longer available under the MIT license."),
    ("unknown", "The drivers are not distributed under the Apache License."),
    ("unknown", "A new licence for the taxi drivers was issued in May."),
    ("unknown", "Copyright is a right of the author, as the teacher explained."),
    ("unknown", "The Apache river flows through the valley."),
    ("unknown", "He was accepted at MIT and at Stanford."),
    ("unknown", "The open source meeting is on Tuesday."),
    ("unknown", "The commons of the village were sold in 1820."),
    ("unknown", "The general public could attend version 2 of the play."),
    ("unknown", "Her driving license was not renewed."),
    ("unknown", "The eclipse was public knowledge, and a licence was not needed to watch."),
    ("unknown", "Mozilla held a conference on public policy."),
    ("unknown", "Please do not redistribute the tickets."),
    ("unknown", "The band released a record under its own name."),
    ("unknown", "Attribution of the painting is disputed."),
    ("unknown", "The restaurant has reserved all tables, rights or not."),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, text) for k, (_, text) in enumerate(HELD)]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}


def test_held_out_sentences(found):
    assert len(HELD) == 60 == len(found)
    named = [("unknown" if found[k].family == "none" else found[k].family, family, text) for k, (family, text) in enumerate(HELD)]
    wrong = [x for x in named if x[0] != x[1]]
    print(wrong)
    assert len(wrong) <= 6


def test_no_other_licence_is_confirmed(found):
    """What permits is never confirmed where the sentence names something else, or nothing."""
    assert [(found[k].family, text) for k, (family, text) in enumerate(HELD) if found[k].confirmed and found[k].family != family] == []
