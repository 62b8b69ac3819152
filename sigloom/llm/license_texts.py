"""Templates of the license scan: full texts, notices and one-line statements, each with its SPDX identifier.

The long texts are files in ``licenses/``; the rest stands here.
"""

from __future__ import annotations

from importlib import resources

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
    "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)


def _gnu(kind: str, version: str, what: str = "program", later: bool = True) -> str:
    """The notice at the head of a file under a GNU licence."""
    either = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; {either}"


#: template -> (SPDX identifier, text)
FULL = {
    "MIT-text": ("MIT", f"{_MIT_GRANT} {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MIT-grant": ("MIT", _MIT_GRANT),
    "BSD-2-Clause-text": ("BSD-2-Clause", f"{_BSD_HEAD} 1. {_BSD_ONE} 2. {_BSD_TWO} {_BSD_TAIL}"),
    "BSD-3-Clause-text": ("BSD-3-Clause", f"{_BSD_HEAD} 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE} {_BSD_TAIL}"),
    "BSD-style-notice": ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "ISC-text": ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR}"),
    "0BSD-text": ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AUTHOR}"),
    "Zlib-text": (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0-text": (
        "BSL-1.0",
        'Boost Software License - Version 1.0 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        f"unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0-notice": (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MPL-2.0-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "MPL-2.0-short-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "GPL-2.0-or-later-notice": ("GPL-2.0-or-later", _gnu("", "2")),
    "GPL-3.0-or-later-notice": ("GPL-3.0-or-later", _gnu("", "3")),
    "GPL-2.0-only-notice": ("GPL-2.0-only", _gnu("", "2", later=False)),
    "GPL-3.0-only-notice": ("GPL-3.0-only", _gnu("", "3", later=False)),
    "LGPL-2.1-or-later-notice": ("LGPL-2.1-or-later", _gnu("Lesser ", "2.1", "library")),
    "LGPL-3.0-or-later-notice": ("LGPL-3.0-or-later", _gnu("Lesser ", "3", "library")),
    "AGPL-3.0-or-later-notice": ("AGPL-3.0-or-later", _gnu("Affero ", "3")),
    "Unlicense-head": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "CC0-1.0-statement": ("CC0-1.0", "Released under CC0 1.0. This work is dedicated to the public domain."),
    "CC0-1.0-waiver": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "All-Rights-Reserved": ("LicenseRef-All-Rights-Reserved", "Copyright. All rights reserved."),
}
#: Words that a notice must hold whatever else differs: what tells it from its neighbours.
_TELLING = {
    "GPL-2.0-or-later-notice": "2 later",
    "GPL-3.0-or-later-notice": "3 later",
    "GPL-2.0-only-notice": "2",
    "GPL-3.0-only-notice": "3",
    "LGPL-2.1-or-later-notice": "lesser 2.1 later",
    "LGPL-3.0-or-later-notice": "lesser 3 later",
    "AGPL-3.0-or-later-notice": "affero 3 later",
    "BSD-style-notice": "bsd-style",
    "CC0-1.0-statement": "cc0",
    "CC0-1.0-waiver": "waived",
    "All-Rights-Reserved": "copyright reserved",
    "Unlicense-head": "unencumbered",
}
_LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
#: SPDX identifier -> names in one-line statements
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2", "GNU GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL v3", "GNU GPL version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
FORMS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.")
#: Words of names that tell no licence from another.
_COMMON = {"the", "license", "licence", "version", "public", "general", "software", "international", "creative", "commons", "work", "universal"}


def templates(words) -> list[tuple[str, str, str, frozenset[str]]]:
    """(template, SPDX identifier, text, words that must be there) of all; ``words`` splits a text."""
    out = [(name, spdx, text, frozenset(_TELLING.get(name, "").split())) for name, (spdx, text) in FULL.items()]
    for spdx in _LONG:
        text = resources.files("sigloom.llm").joinpath("licenses", f"{spdx}.txt").read_text(encoding="utf-8")
        out.append((f"{spdx}-text", spdx, text, frozenset()))
    for spdx, names in NAMES.items():
        out.append((f"{spdx}-spdx", spdx, f"SPDX-License-Identifier: {spdx}", frozenset(words(spdx))))
        for i, name in enumerate(names):
            must = frozenset(words(name)) - _COMMON
            for j, form in enumerate(FORMS):
                if name.startswith("CC") and j < 2:
                    out.append((f"{spdx}-{i}{j}-bare", spdx, form.replace("the ", "").format(name), must))
                out.append((f"{spdx}-{i}{j}", spdx, form.format(name), must))
    return out
