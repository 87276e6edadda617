"""Notices and texts of common licenses, as published, and the words that tell them apart.

A template is ``(license, kind, marks, text)``.  ``marks`` are words of the text, each written there once, without
which a place is not this license.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    license: str
    kind: str
    marks: tuple[str, ...]
    text: str


#: Words that name a license.  One that stands unaligned inside a place names another license than the template.
NAMES = frozenset("""affero agpl apache artistic bsd bsl cddl cecill cpl eclipse epl eupl gnu gpl isc lesser lgpl library mit mozilla mpl
                     nc nd noncommercial noderivatives proprietary sa sharealike unlicense wtfpl zlib zero""".split())

# The wording of notices and licenses.
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GNU = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as
published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {what} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."""
_GNU_SHORT = """you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law."""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the
public domain worldwide. This software is distributed without any warranty."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""


def _gnu(text: str, name: str, version: str) -> str:
    return text.format(what="library" if name == "Lesser " else "program", colon=":", comma=",", name=name, version=version)


TEMPLATES = {
    "apache-2.0": Template("apache-2.0", "permissive", ("apache",), "Licensed under the Apache License, Version 2.0"),
    "apache-2.0-header": Template("apache-2.0", "permissive", ("file", "compliance"), _APACHE),
    "mit": Template("mit", "permissive", ("mit",), "Released under the MIT License"),
    "mit-short": Template("mit", "permissive", ("mit",), "Licensed under the MIT License"),
    "mit-text": Template("mit", "permissive", ("sublicense",), _MIT),
    "bsd": Template("bsd", "permissive", ("bsd",), "Released under the BSD License"),
    "bsd-short": Template("bsd", "permissive", ("bsd",), "Licensed under the BSD License"),
    "bsd-2-text": Template("bsd-2-clause", "permissive", ("reproduce",), f"{_BSD_1} {_BSD_END}"),
    "bsd-3-text": Template("bsd-3-clause", "permissive", ("reproduce", "neither", "endorse", "promote"), f"{_BSD_1} {_BSD_3} {_BSD_END}"),
    "bsd-notice": Template("bsd", "permissive", ("binary",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "isc-text": Template("isc", "permissive", ("fee",), f"{_ISC} {_ISC_END}"),
    "isc-notice": Template("isc", "permissive", ("fee",), _ISC),
    "zlib-text": Template("zlib", "permissive", ("acknowledgment", "plainly"), _ZLIB),
    "mpl-2.0": Template("mpl-2.0", "weak copyleft", ("mozilla",), "Mozilla Public License Version 2.0"),
    "mpl-2.0-header": Template("mpl-2.0", "weak copyleft", ("form",), _MPL),
    "gpl": Template("gpl", "copyleft", ("gnu",), "licensed under the GNU General Public License"),
    "gpl-2.0-header": Template("gpl-2.0", "copyleft", ("2",), _gnu(_GNU, "", "2")),
    "gpl-3.0-header": Template("gpl-3.0", "copyleft", ("3",), _gnu(_GNU, "", "3")),
    "gpl-2.0-notice": Template("gpl-2.0", "copyleft", ("gnu", "2"), _gnu(_GNU_SHORT, "", "2")),
    "gpl-3.0-notice": Template("gpl-3.0", "copyleft", ("gnu", "3"), _gnu(_GNU_SHORT, "", "3")),
    "lgpl": Template("lgpl", "weak copyleft", ("gnu", "lesser"), "licensed under the GNU Lesser General Public License"),
    "lgpl-2.1-notice": Template("lgpl-2.1", "weak copyleft", ("gnu", "lesser", "1"), _gnu(_GNU_SHORT, "Lesser ", "2.1")),
    "lgpl-3.0-notice": Template("lgpl-3.0", "weak copyleft", ("gnu", "lesser", "3"), _gnu(_GNU_SHORT, "Lesser ", "3")),
    "agpl": Template("agpl", "network copyleft", ("gnu", "affero"), "licensed under the GNU Affero General Public License"),
    "agpl-3.0-notice": Template("agpl-3.0", "network copyleft", ("gnu", "affero", "3"), _gnu(_GNU_SHORT, "Affero ", "3")),
    "unlicense-text": Template("unlicense", "public domain", ("unencumbered",), _UNLICENSE),
    "cc0-1.0": Template("cc0-1.0", "public domain", ("neighboring", "dedicated"), _CC0),
    "cc0-1.0-short": Template("cc0-1.0", "public domain", ("cc0",), "Licensed under CC0 1.0"),
    "cc-by-nc-4.0": Template("cc-by-nc-4.0", "non-commercial", ("cc", "nc"), "Licensed under CC BY-NC 4.0"),
    "cc-by-sa-4.0": Template("cc-by-sa-4.0", "share-alike", ("cc", "sa"), "Licensed under CC BY-SA 4.0"),
    "cc-by-nd-4.0": Template("cc-by-nd-4.0", "no derivatives", ("cc", "nd"), "Licensed under CC BY-ND 4.0"),
    "cc-by-nc-sa-4.0": Template("cc-by-nc-sa-4.0", "non-commercial", ("cc", "nc", "sa"), "Licensed under CC BY-NC-SA 4.0"),
    "cc-by-nc-nd-4.0": Template("cc-by-nc-nd-4.0", "non-commercial", ("cc", "nc", "nd"), "Licensed under CC BY-NC-ND 4.0"),
    "cc-by-4.0": Template("cc-by-4.0", "attribution", ("cc",), "Licensed under CC BY 4.0"),
    "reserved": Template("all rights reserved", "reserved", ("reserved",), "All rights reserved"),
}
