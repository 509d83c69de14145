"""Wording of licence notices as templates, in the markup of public licence lists.

Fixed values: the wording is that of the licences themselves. ``<<beginOptional>>`` ... ``<<endOptional>>`` may be missing;
``<<var;name="...";original="...";match="...">>`` may be replaced: ``.{a,b}`` by a to b words, ``x|y`` by one of
these wordings.
"""

_HOLDER = '<<var;name="holder";original="the copyright holder";match=".{1,12}">>'

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
<<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";original="the authors or copyright holders";match=".{1,12}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.<<endOptional>>"""

_ISC = """Permission to use, copy, modify, and<<var;name="slash";original="/or";match=" or|">> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<var;name="bullet";original="1.";match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. <<var;name="bullet";original="2.";match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_NAMES = f"""<<var;name="bullet";original="3.";match=".{{0,1}}">> Neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_BSD_END = 'THIS SOFTWARE IS PROVIDED BY <<var;name="provider";original="the copyright holders and contributors";match=".{1,12}">> "AS IS"'

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the
<<var;name="authors";original="authors";match="author|authors">> be held liable for any damages arising from the use of this software. Permission is granted to anyone
to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;name="scheme";original="http";match="http|https">>://www.apache.org/licenses/LICENSE-2.0"""

_GPL_PUBLISHED = '<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<var;name="either";original="either";match="either|">> version'

#: (label, template). A label may have several.
TEMPLATES = [
    ("mit", _MIT),
    ("mit", 'licensed under the <<beginOptional>>terms of the<<endOptional>> <<var;name="name";original="MIT";match="MIT|Expat">> license'),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", _ISC),
    ("bsd-2", f"{_BSD_HEAD} {_BSD_END}"),
    ("bsd-3", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_END}"),
    ("zlib", _ZLIB),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("apache-2", _APACHE),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2", f"GNU General Public License {_GPL_PUBLISHED} 2"),
    ("gpl-3", f"GNU General Public License {_GPL_PUBLISHED} 3"),
    ("lgpl-2.1", f"GNU Lesser General Public License {_GPL_PUBLISHED} 2.1"),
    ("lgpl-3", f"GNU Lesser General Public License {_GPL_PUBLISHED} 3"),
    ("agpl-3", f"GNU Affero General Public License {_GPL_PUBLISHED} 3"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc-by", 'licensed under <<var;name="article";original="a";match="a|the|">> Creative Commons Attribution <<var;name="version";original="4.0";match="3.0|4.0">> <<var;name="reach";original="International";match="International|Unported">> License'),
    ("cc-by-sa", 'Creative Commons Attribution-<<var;name="share";original="ShareAlike";match="ShareAlike|Share Alike">> <<var;name="version";original="4.0";match="2.0|2.5|3.0|4.0">>'),
    ("cc-by-nc", 'Creative Commons Attribution-<<var;name="use";original="NonCommercial";match="NonCommercial|Non Commercial">> <<var;name="version";original="4.0";match="2.0|2.5|3.0|4.0">>'),
]

#: (label, phrase): each place where the words of a phrase stand side by side counts.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
