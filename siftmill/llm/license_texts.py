"""Wordings of licences that documents quote."""

from __future__ import annotations

# Notices and heads of licence texts as their publishers word them, by SPDX name.
WORDINGS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
        "DISTRIBUTION",
    ),
    (
        "GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, "
        "Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, "
        "but changing it is not allowed.",
    ),
    (
        "LGPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "LGPL-2.1-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 "
        "Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this "
        "license document, but changing it is not allowed.",
    ),
    (
        "AGPL-3.0-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "<https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is "
        "not allowed.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MIT", "MIT License Copyright (c)"),
    ("MIT", "The MIT License (MIT) Copyright (c)"),
    ("ISC", "ISC License Copyright (c)"),
    ("BSD-2-Clause", "BSD 2-Clause License Copyright (c)"),
    ("BSD-3-Clause", "BSD 3-Clause License Copyright (c)"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide."),
)

# SPDX names that identifiers and one-line notices use.
IDENTIFIERS = (
    "Apache-2.0 MIT ISC 0BSD Unlicense BSD-2-Clause BSD-3-Clause MPL-2.0 EPL-2.0 BSL-1.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
    "GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
).split()

# GNU licences (SPDX name, name in prose, versions) and the kinds of Creative Commons (code, name).
GNU = (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",)))
CREATIVE_COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)


def _gnu() -> list[tuple[str, str]]:
    made = []
    for code, kind, versions in GNU:
        for version in versions:
            spdx = f"{code}-{version if '.' in version else version + '.0'}"
            name = f"GNU {kind} Public License"
            made += [
                (f"{spdx}-only", f"This work is licensed under the {name}, version {version}."),
                (f"{spdx}-only", f"Licensed under the {name}, version {version} only."),
                (f"{spdx}-or-later", f"Licensed under the {name}, version {version} or later."),
                (f"{spdx}-or-later", f"Licensed under the {name}, either version {version} or (at your option) any later version."),
                (
                    f"{spdx}-or-later",
                    f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
                    f"Foundation, either version {version} of the License, or (at your option) any later version.",
                ),
                (
                    f"{spdx}-only",
                    f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
                    f"Foundation, version {version} of the License.",
                ),
            ]
    return made


def _creative_commons() -> list[tuple[str, str]]:
    made = []
    for code, kind in CREATIVE_COMMONS:
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            spdx = f"CC-{code}-{version}"
            made += [
                (spdx, f"Licensed under CC {code} {version}."),
                (spdx, f"This work is licensed under a Creative Commons {kind} {version} {place} License."),
            ]
    return made


def _named() -> list[tuple[str, str]]:
    return [(name, wording.format(name)) for name in IDENTIFIERS for wording in ("SPDX-License-Identifier: {}", "Licensed under {}.")]


TEMPLATES = (*WORDINGS, *_gnu(), *_creative_commons(), *_named())
