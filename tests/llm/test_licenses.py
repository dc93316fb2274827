import re

from tastemill.llm import licenses

MIT = next(iter(licenses.SENTENCES["mit-grant"])).replace(" subject to", "\nsubject to")
WARRANTY = licenses.SENTENCES["mit-warranty"][0]


def test_sequences_rules_and_rest(docs_of, by_id):
    rows = [
        (1, f"MIT License\n\n{MIT.capitalize()}.\n\nTHE SOFTWARE {WARRANTY[13:].upper()}."),
        (2, "Prose. Released under the MIT License.\nLicensed under CC BY-NC 4.0. End"),
        (3, "Licensed under the Apache License, Version 2.0"),
        (4, "You may not use this file except in compliance with the License."),
        (5, "we licensed nothing here"), (6, ""), (7, None), (8, "  " * 5000 + "." * 5000 + "license"),
    ]
    got = by_id(licenses.recognise(docs_of(*rows)))
    pick = lambda i: (got[i]["n_sentences"], got[i]["licenses"], got[i]["unmatched"])
    assert pick(1) == (3, "MIT", "")
    assert pick(2) == (2, "MIT,CC-BY-NC-4.0", "")
    assert pick(3) == (1, "Apache-2.0", "")
    assert pick(4) == (1, "", "apache-limit")
    assert all(pick(i) == (0, "", "") for i in (5, 6, 7, 8))
    assert licenses.recognise(docs_of((1, "x")).limit(0)).count() == 0


def test_every_sentence_holds_a_trigger_and_is_normalised():
    for text in licenses.known_sentences():
        assert re.search(licenses.TRIGGER, text) and re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", text)
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_unchanged_public_texts(docs_of, by_id):
    tight, bullets = BSD_TEXT.replace("\n\n", "\n"), re.sub(r"\n\n\d\.", "\n *", BSD_TEXT)
    commented = "".join(f"# {line}".rstrip() + "\n" for line in APACHE_HEADER.splitlines())
    texts = {
        MIT_TEXT: "MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + MIT_TEXT: "MIT",
        BSD_TEXT: "BSD-2-Clause", BSD_TEXT + BSD_NAME: "BSD-3-Clause", tight: "BSD-2-Clause",
        tight + BSD_NAME[1:]: "BSD-3-Clause", bullets: "BSD-2-Clause", APACHE_HEADER: "Apache-2.0",
        commented: "Apache-2.0", MPL_HEADER: "MPL-2.0", GPL_HEADER: "GPL-3.0-or-later",
    }
    got = by_id(licenses.recognise(docs_of(*enumerate(texts))))
    for i, (text, name) in enumerate(texts.items()):
        assert (got[i]["licenses"], got[i]["unmatched"]) == (name, ""), text
