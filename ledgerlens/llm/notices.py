"""Texts of public licences that the licence scan looks for, by label.

Fixed values: the wordings below are those of the licences themselves. Short licences stand whole, from the first
word after the copyright line; of long ones, the notice that files carry and the opening of the body. Case and
punctuation do not matter. Notices that differ by a name or a version come from a rule (``family``), one
for each version, so that a text finds its own version closer than another.
"""

from __future__ import annotations

_AS_IS_HOLDERS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD_OPENING = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""

#: Whole licences and openings of long ones: (label, text).
BODIES = [
    ("mit", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""),
    ("isc", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""),
    ("bsd-2", _BSD_OPENING + _AS_IS_HOLDERS),
    ("bsd-3", _BSD_OPENING + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
""" + _AS_IS_HOLDERS),
    ("zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.
"""),
    ("bsl-1", """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction
and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
"""),
    ("unlicense", """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.
"""),
    ("apache-2", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.
"""),
    ("apache-2", """
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions.
"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through
9 of this document.
"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.
"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or
are under common control with that entity.
"""),
    ("mpl-2", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""),
    ("epl-2", """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0
"""),
    ("gpl-2", """
The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
General Public License is intended to guarantee your freedom to share and change free software--to make sure the
software is free for all its users. This General Public License applies to most of the Free Software Foundation's
software and to any other program whose authors commit to using it.
"""),
    ("gpl-3", """
The GNU General Public License is a free, copyleft license for software and other kinds of works.
The licenses for most software and other practical works are designed to take away your freedom to share and change
the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all
versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use
the GNU General Public License for most of our software; it applies also to any other work released this way by its
authors.
"""),
    ("agpl-3", """
The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically
designed to ensure cooperation with the community in the case of network server software.
The licenses for most software and other practical works are designed to take away your freedom to share and change
the works. By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all
versions of a program--to make sure it remains free software for all its users.
"""),
    ("lgpl-2.1", """
The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the
software is free for all its users. This license, the Lesser General Public License, applies to some specially
designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use
it.
"""),
    ("lgpl-3", """
This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU
General Public License, supplemented by the additional permissions listed below.
"""),
]

#: One-line notices: (label, text).
LINES = [
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
]

#: Notices of the GNU licences; {name} and {version} follow from GNU.
GNU_NOTICES = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published "
    "by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.",
    "under the terms of the {name} as published by the Free Software Foundation, either version {version}",
    "under the terms of the {name} version {version} as published by the Free Software Foundation",
    "under the terms of version {version} of the {name}",
    "licensed under the {name} version {version}",
    "licensed under the {name} v{version}",
]
#: (label, name, version).
GNU = [
    ("gpl-2", "GNU General Public License", "2"),
    ("gpl-3", "GNU General Public License", "3"),
    ("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3", "GNU Lesser General Public License", "3"),
    ("agpl-3", "GNU Affero General Public License", "3"),
]

#: Notices of the Creative Commons licences; {name} and {version} follow from CC.
CC_NOTICES = [
    "This work is licensed under a Creative Commons {name} {version} International License",
    "This work is licensed under the Creative Commons {name} {version} International License",
    "licensed under Creative Commons {name} {version}",
]
#: (label, name, version).
CC = [
    ("cc-by", "Attribution", "4.0"),
    ("cc-by-sa", "Attribution-ShareAlike", "4.0"),
    ("cc-by-nd", "Attribution-NoDerivatives", "4.0"),
    ("cc-by-nc", "Attribution-NonCommercial", "4.0"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "4.0"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "4.0"),
]

#: Identifiers after "SPDX-License-Identifier:": (label, identifier).
SPDX = [
    ("mit", "MIT"), ("isc", "ISC"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("bsl-1", "BSL-1.0"),
    ("bsd-2", "BSD-2-Clause"), ("bsd-3", "BSD-3-Clause"), ("apache-2", "Apache-2.0"), ("mpl-2", "MPL-2.0"),
    ("epl-2", "EPL-2.0"), ("gpl-2", "GPL-2.0-only"), ("gpl-2", "GPL-2.0-or-later"), ("gpl-3", "GPL-3.0-only"),
    ("gpl-3", "GPL-3.0-or-later"), ("lgpl-2.1", "LGPL-2.1-only"), ("lgpl-2.1", "LGPL-2.1-or-later"),
    ("lgpl-3", "LGPL-3.0-only"), ("lgpl-3", "LGPL-3.0-or-later"), ("agpl-3", "AGPL-3.0-only"),
    ("agpl-3", "AGPL-3.0-or-later"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"),
    ("cc-by-nd", "CC-BY-ND-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0"),
]


def family(patterns: list[str], members: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """Every pattern for every member: (label, text)."""
    return [(label, p.format(name=name, version=version)) for label, name, version in members for p in patterns]


def standard() -> dict[str, str]:
    """All templates as text -> label."""
    spdx = [(label, f"SPDX-License-Identifier: {name}") for label, name in SPDX]
    return {text: label for label, text in BODIES + LINES + family(GNU_NOTICES, GNU) + family(CC_NOTICES, CC) + spdx}
