"""Public licence notices, as words: templates of the families, and notices of licences that are none of them."""

_PERMISSION = (
    "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit "
    "persons to whom the Software is furnished to do so subject to the following conditions"
)
_GNU_FREE = (
    "This program is free software you can redistribute it and or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation "
    "either version {1} of the License or at your option any later version"
)
_GNU_HOPE = (
    "This program is distributed in the hope that it will be useful but WITHOUT ANY WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE "
    "See the GNU {0}General Public License for more details"
)
_GNU_COPY = "You should have received a copy of the GNU {0}General Public License along with this program If not see"


def _gnu(kind: str, version: str) -> list[str]:
    return [x.format(kind, version) for x in (_GNU_FREE, _GNU_HOPE, _GNU_COPY)]


def _commons(letters: str, words: str) -> list[str]:
    return [f"Licensed under CC BY{letters} 4.0", f"Available under CC BY{letters} 3.0", f"This work is licensed under a Creative Commons Attribution{words} 4.0 International License", f"SPDX License Identifier CC BY{letters} 4.0"]


TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License version 3", "Licensed under the AGPL version 3", "SPDX License Identifier AGPL 3.0 or later", *_gnu("Affero ", "3")],
    "all-rights-reserved": ["All rights reserved", "Copyright the authors all rights reserved", "No part of this publication may be reproduced without permission of the publisher"],
    "apache-2.0": [
        "Licensed under the Apache License Version 2.0",
        "Released under the Apache 2.0 license",
        "SPDX License Identifier Apache 2.0",
        "Licensed under the Apache License Version 2.0 the License you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
        "http www apache org licenses LICENSE 2.0",
        "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied "
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "bsd": [
        "Licensed under the BSD 3 Clause License",
        "Released under the 2 clause BSD license",
        "Licensed under the BSD License",
        "SPDX License Identifier BSD 3 Clause",
        "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc-by": _commons("", ""),
    "cc-by-nc": _commons(" NC", " NonCommercial"),
    "cc-by-nc-nd": _commons(" NC ND", " NonCommercial NoDerivatives"),
    "cc-by-nc-sa": _commons(" NC SA", " NonCommercial ShareAlike"),
    "cc-by-nd": _commons(" ND", " NoDerivatives"),
    "cc-by-sa": _commons(" SA", " ShareAlike"),
    "cc0": ["Dedicated to the public domain under CC0 1.0", "To the extent possible under law the author has waived all copyright and related rights to this work", "Licensed under CC0 1.0 Universal"],
    "gpl": ["This work is licensed under the GNU General Public License version 3", "SPDX License Identifier GPL 3.0 or later", "Released under the GPL version 2", "Licensed under the GPL version 3", *_gnu("", "3")],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License version 2.1", "SPDX License Identifier LGPL 2.1", "Licensed under the LGPL version 3", *_gnu("Lesser ", "2.1")],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX License Identifier MIT",
        _PERMISSION,
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0",
        "SPDX License Identifier MPL 2.0",
        "If a copy of the MPL was not distributed with this file You can obtain one at http mozilla org MPL 2.0",
    ],
}

OTHER: list[str] = [
    "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "This software is provided as is without any express or implied warranty In no event will the authors be held liable for any damages arising from the use of this software",
    "Licensed under the European Union Public Licence EUPL version 1.2",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "The contents of this file are subject to the terms of the Common Development and Distribution License You may not use this file except in compliance with the License",
    "Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "Boost Software License Version 1.0 Permission is hereby granted to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "This is free and unencumbered software released into the public domain Anyone is free to copy modify publish use compile sell or distribute this software",
    "This Font Software is licensed under the SIL Open Font License Version 1.1",
    "Licensed under the Artistic License 2.0",
    "Use of this software is governed by the Business Source License included in the LICENSE file",
    "Licensed under the Elastic License 2.0 you may not provide the software to third parties as a hosted or managed service",
    "Released under the Eclipse Public License version 2.0",
    "Licensed under the ISC License",
    "Made available under the Open Database License",
]
