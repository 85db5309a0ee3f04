"""Wording of common licences and notices: texts and headers as they are published, and short statements made by rule from names."""

from __future__ import annotations

_CC = "This work is licensed under {} Creative Commons {} 4.0 International License."

# Texts and headers; "_" stands for a name or a year, of any wording.
TEXTS = {
    ("Apache-2.0", "notice"): 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ("MIT", "text"): 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ("MIT", "disclaimer"): 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ("GPL-3.0", "notice"): "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ("GPL-2.0", "notice"): "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ("LGPL-2.1", "notice"): "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ("LGPL-3.0", "notice"): "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ("AGPL-3.0", "notice"): "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ("GPL", "disclaimer"): "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ("BSD-2-Clause", "text"): "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ("BSD-3-Clause", "text"): "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of _ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ("BSD", "disclaimer"): 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ("ISC", "text"): "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ("Zlib", "text"): "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ("BSL-1.0", "text"): 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so',
    ("BSL-1.0", "notice"): "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ("MPL-2.0", "notice"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ("EPL-2.0", "notice"): "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ("CDDL-1.0", "notice"): 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
    ("EUPL-1.2", "notice"): 'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
    ("OFL-1.1", "notice"): "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://openfontlicense.org",
    ("Unlicense", "text"): "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ("WTFPL", "text"): "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    ("CC0-1.0", "notice"): "To the extent possible under law, _ has waived all copyright and related or neighboring rights to this work.",
    ("CC-BY-4.0", "statement"): _CC.format("a", "Attribution"),
    ("CC-BY-SA-4.0", "statement"): _CC.format("a", "Attribution-ShareAlike"),
    ("CC-BY-NC-4.0", "statement"): _CC.format("a", "Attribution-NonCommercial"),
    ("CC-BY-ND-4.0", "statement"): _CC.format("a", "Attribution-NoDerivatives"),
    ("CC-BY-NC-SA-4.0", "statement"): _CC.format("a", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-NC-ND-4.0", "statement"): _CC.format("a", "Attribution-NonCommercial-NoDerivatives"),
    ("GPL-3.0", "statement"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-2.0", "statement"): "This work is licensed under the GNU General Public License, version 2.",
}

# Names by which statements call a licence.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "0BSD": ("Zero-Clause BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "3-clause BSD license", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL v3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License",),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "MS-PL": ("Microsoft Public License",),
    "PSF-2.0": ("Python Software Foundation License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "ODbL-1.0": ("Open Database License",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal license"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 license"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: How a statement begins; an article may follow.
LEADS, ARTICLES = ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "is under"), ("", "the ", "a ")
#: Statements of other forms.
FORMS = ("License: {}", "{} licensed")


def templates() -> dict[tuple[str, str], list[str]]:
    """Wordings by licence and kind: texts, notices and disclaimers; statements, of every beginning with every name; SPDX tags."""
    out = {key: [text] for key, text in TEXTS.items()}
    for licence, names in NAMES.items():
        said = [f"{lead} {article}{name}." for lead in LEADS for name in names for article in ARTICLES]
        said += [form.format(name) for form in FORMS for name in names if not name.lower().endswith(("license", "licence"))]
        out.setdefault((licence, "statement"), []).extend(said)
        tags = [licence, *(f"{licence}-{x}" for x in ("only", "or-later") if "GPL" in licence)]
        out[licence, "tag"] = [f"SPDX-License-Identifier: {x}" for x in tags]
    return out
