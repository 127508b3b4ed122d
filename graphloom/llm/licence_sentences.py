"""The sentences of common licences and notices, word for word as published, in the order of the text.

Case, punctuation and line ends don't count.
"""

from __future__ import annotations

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution"
)
_BSD_AS_IS = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, "
    "including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
)
_BSD_LIABLE = (
    "In no event shall the copyright {} or contributors be liable for any direct, indirect, incidental, special, exemplary, "
    "or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, "
    "or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict "
    "liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if "
    "advised of the possibility of such damage"
)
_GNU_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
)
_GNU_GRANT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public "
    "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
)
_GNU_DETAILS = "See the GNU {}General Public License for more details"
_GNU_COPY = "You should have received a copy of the GNU {}General Public License along with this program"


def _gnu(name: str, version: str) -> list[str]:
    own = [_GNU_GRANT.format(name, version), _GNU_WARRANTY, _GNU_DETAILS.format(name), _GNU_COPY.format(name)]
    return own + [_GNU_COPY.format("")] * bool(name)  # files often name the general licence there


#: (licence, its sentences)
TEXTS: list[tuple[str, list[str]]] = [
    ("MIT", [
        _MIT_GRANT,
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the "
        "warranties of merchantability, fitness for a particular purpose and noninfringement",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an "
        "action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other "
        "dealings in the software",
    ]),
    ("BSD-3-Clause", [
        _BSD_GRANT, _BSD_SOURCE, _BSD_BINARY,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
        _BSD_AS_IS, _BSD_LIABLE.format("holder"),
    ]),
    ("BSD-2-Clause", [_BSD_GRANT, _BSD_SOURCE, _BSD_BINARY, _BSD_AS_IS, _BSD_LIABLE.format("holder")]),
    ("ISC", [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness",
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages "
        "whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious "
        "action, arising out of or in connection with the use or performance of this software",
    ]),
    ("Zlib", [
        "This software is provided as-is, without any express or implied warranty",
        "In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions:",
    ]),
    ("Unlicense", [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ]),
    ("BSL-1.0", [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:",
    ]),
    ("Apache-2.0", [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ]),
    ("GPL-3.0", _gnu("", "3")),
    ("GPL-2.0", _gnu("", "2")),
    ("LGPL", _gnu("Lesser ", "3")),
    ("AGPL", _gnu("Affero ", "3")),
    ("MPL", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ]),
]
#: (sentence, another wording of it)
VARIANTS: list[tuple[str, str]] = [(_BSD_LIABLE.format("holder"), _BSD_LIABLE.format(x)) for x in ("owner", "holders", "owners")]
