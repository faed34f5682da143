"""Token counts, the BPE codec and licence scans against libraries and fixed cases."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventlane.llm import bpe, licenses, queries, token_counts
from eventlane.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a  b ", " \n x \n\n", "a▁b ▁", "Hello <|startoftext|> it's ÉTÉ Σας İ <|endoftext|>", "a\x1cb\x85c d", "don't WE'LL !'s a1's 12",
    "漢字 ½ Ⅷ \U0001f600", "ab" * 3000, "x" * 70 + " " + "é" * 200, "<s> </s> <0x0A> <unk>", "\x00a\x00", "é ﬁ", "tab\tnew\r\nline",
]
ALPHABET = st.text(alphabet=st.sampled_from(list("aabcd eE\n\t ▁'.,<|>éÉß漢12İΣ́ ")) | st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"]), max_size=60)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def lengths():
    with open(PIECES, "rb") as file:
        return token_counts.Lengths(file.read(), {"the": 1}, 50)


@pytest.fixture(scope="module")
def codec():
    with open(WORDS, "rb") as file:
        return bpe.Codec(file.read(), room=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def same(codec, library, texts):
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False)
        assert ids == np.array(expected.ids, "<u4").tobytes(), text
        assert codec.decode(ids) == library.decode(expected.ids, skip_special_tokens=False), text


def test_counts_of_odd_texts(lengths, pieces):
    assert lengths.count(ODD) == [len(pieces.encode(t)) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ALPHABET, max_size=4))
def test_counts_of_any_text(lengths, pieces, texts):
    assert lengths.count(texts) == [len(pieces.encode(t)) for t in texts]


def test_ids_of_odd_texts(codec, library):
    same(codec, library, ODD)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ALPHABET, max_size=4))
def test_ids_of_any_text(codec, library, texts):
    same(codec, library, texts)


def test_tree_takes_the_leftmost_lowest_rank(codec):
    # One tree and many trees must agree, and so must plain repeated search.
    ranks, merged = codec.tree.ranks, codec.tree.merged
    for word in ("abababab", "thththe", "aaaaaaaaa", "internationalisation"):
        row = [*codec.inner[list(word[:-1].encode())].tolist(), int(codec.last[ord(word[-1])])]
        plain = list(row)
        while True:
            best = min(((ranks.get(a << 32 | b, len(merged)), i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False))), default=(len(merged), 0))
            if best[0] == len(merged):
                break
            plain[best[1] : best[1] + 2] = [merged[best[0]]]
        assert codec.tree.merge(list(row)) == plain
        assert codec.merged([word])[word] == np.array(plain, "<u4").tobytes()


def test_token_count_query(spark, pieces):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    rows = queries.op1_token_counts(spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len(t.encode()), n := len(pieces.encode(t)), n > 4096) for i, t in texts.items()
    }


def test_codec_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF_DIR, "documents").collect()}
    rows = queries.op3_bpe_codec(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark, library, pieces):
    rows = [(1, None, 7, "x"), (2, "", 7, "x"), (3, "The cat", 7, "x"), (3, "The cat", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    counted = token_counts.count_tokens(df, PIECES).orderBy("doc_id").collect()
    assert [r.n_tokens for r in counted] == [0, 0, *[len(pieces.encode("The cat"))] * 2]
    ids = np.array(library.encode("The cat", add_special_tokens=False).ids, "<u4").tobytes()
    coded = bpe.encode(df, WORDS)
    assert [bytes(r.ids) for r in coded.orderBy("doc_id").collect()] == [b"", b"", ids, ids]
    back = bpe.decode(coded, WORDS, out="back").orderBy("doc_id").collect()
    assert [r.back for r in back] == ["", "", "the</w> cat</w>", "the</w> cat</w>"]
    assert bpe.encode_digests(df, WORDS).orderBy("doc_id").first().n_tokens == 0
    assert [r.n_tokens for r in bpe.digested(coded, WORDS).orderBy("doc_id").collect()] == [0, 0, 2, 2]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, PIECES).collect() == []
    assert bpe.encode(empty, WORDS).collect() == []
    assert licenses.scan(empty).collect() == []


def test_model_with_pieces_across_words_is_refused():
    class Odd:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, _):
            return "a▁b"

    with pytest.raises(ValueError, match="across words"):
        token_counts.check_model(Odd())


# --- licences -----------------------------------------------------------------------------

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
CASES = [
    ("Some words.\nReleased under the MIT License.\nMore.", [("MIT", "Released under the MIT License.", 1)]),
    ("No period here\nLicensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", 1)]),
    ("This work is licensed under the GNU General Public License, version 3.", [("GPL-3.0", None, 1)]),
    ("x. LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. y", [("Apache-2.0", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", 1)]),
    ("# SPDX-License-Identifier: BSD-3-Clause\ncode", [("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause", 1)]),
    (MIT, [("MIT", None, 3)]),
    ("Released under the MIT License. Licensed under CC BY 4.0.", [("MIT", None, 1), ("CC-BY-4.0", None, 1)]),
    ("We licensed the software and discuss its license.", []),
    (None, []), ("", []),
]


def test_licences_of_fixed_texts(spark):
    rows = [(i, text, 1) for i, (text, _) in enumerate(CASES)] * 2
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, start int")).orderBy("doc_id", "start").collect()
    for i, (text, expected) in enumerate(CASES):
        own = [r for r in found if r.doc_id == i]
        assert len(own) == 2 * len(expected)
        for r, (name, span, n) in zip(own[::2], expected, strict=True):
            assert (r.license, r.n_sentences) == (name, n)
            assert span is None or span in text[r.start : r.end + 1] or span.startswith(text[r.start : r.end])


def test_licence_query_against_plain_lines(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    plain = sorted((r.doc_id, licence) for r in docs.collect() for notice, licence in notices.items() for _ in range((r.text or "").lower().count(notice.lower())))
    found = sorted((r.doc_id, r.license) for r in queries.op7_licenses(spark, "/root/testdata/sf0.01").select("doc_id", "license").collect())
    assert found == plain and plain


def gnu_header(name, version, what="program", first=";", second=";", end="either version {} of the License, or\n(at your option) any later version."):
    return f"""    This {what} is free software{first} you can redistribute it and/or modify
    it under the terms of the {name} as published by
    the Free Software Foundation{second} {end.format(version)}

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    {name} for more details.
"""


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
HEADERS = [
    ("GPL-2.0-or-later", gnu_header("GNU General Public License", "2")),
    ("GPL-2.0-only", gnu_header("GNU General Public License", "2", end="version {} of the License.")),
    ("GPL-3.0-or-later", gnu_header("GNU General Public License", "3", first=":", second=",")),
    ("LGPL-2.0-or-later", gnu_header("GNU Library General Public License", "2", "library")),
    ("LGPL-2.1-or-later", gnu_header("GNU Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0-or-later", gnu_header("GNU Lesser General Public License", "3", first=":", second=",")),
    ("AGPL-3.0-or-later", gnu_header("GNU Affero General Public License", "3", first=":", second=",")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("EPL-1.0", """This program and the accompanying materials are made available under the terms of
the Eclipse Public License v1.0 which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0.
   (See accompanying file LICENSE_1_0.txt or copy at
         https://www.boost.org/LICENSE_1_0.txt)"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""),
    ("MIT", MIT), ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + """3. Neither the name of Some Body nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific prior
   written permission."""),
    ("BSD", "Released under the BSD License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@pytest.mark.parametrize(("licence", "header"), HEADERS)
def test_published_headers(licence, header):
    found = licenses.recognised(f"Some words.\n\n{header}\n\nMore words.", licenses.knowledge())
    assert [f[0] for f in found] == [licence]


def test_every_listed_licence_has_a_header():
    assert set(licenses.RULES) <= {licence for licence, _ in HEADERS}


def test_holder_of_any_length():
    for name in ("x", "the University of " + "Somewhere and " * 40 + "its partners"):
        clause = f"Neither the name of {name} nor the names of its contributors may be used"
        assert licenses.normal(clause) == "neither the name of the copyright holder nor the names of its contributors may be used"
    assert licenses.normal("neither the name of a") == "neither the name of a"


def test_triggers_of_own_knowledge():
    own = licenses.Knowledge({"use it as you like": "a", "all yours": "b", "no strings": "c"}, (("Own", ("a", "b?")), ("Free", ("c?",))))
    assert [r[0] for r in licenses.recognised("Take it. Use it as you like. All yours.", own)] == ["Own"]
    assert [r[0] for r in licenses.recognised("No strings!", own)] == ["Free"]


def test_rules_name_known_sentences():
    own = licenses.knowledge()
    names = set(own.sentences.values())
    assert {item.rstrip("?") for _, rule in own.rules for item in rule} <= names
    assert all(licenses.normal(s) == s for s in own.sentences)
