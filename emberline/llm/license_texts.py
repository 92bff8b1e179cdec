"""Licence texts, standard headers and usual notices, beside the short forms of ``license_scan``."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with
this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_LATER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version."""
_WARRANTY = """This {what} is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {name} for more details."""
_ONLY = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} as published by
the Free Software Foundation."""
_GNU = (
    ("GPL-1.0", "program", "General Public License", "1"),
    ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.0", "library", "Library General Public License", "2"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
)
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _notices() -> list[tuple[str, str]]:
    out = [("Apache-2.0", _APACHE), ("Apache-2.0", _ASF), ("MPL-2.0", _MPL)]
    out.append(("Apache-2.0", "Distributed under the terms of the Apache License, Version 2.0."))
    out.append(("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."))
    out += [("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the terms of the MIT license."), ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1.")]
    for licence, what, name, version in _GNU:
        out += [(licence, form.format(what=what, name=name, version=version)) for form in (_LATER, f"{_LATER} {_WARRANTY}", _ONLY, f"{_ONLY} {_WARRANTY}")]
        out.append((licence, f"This {what} is licensed under the GNU {name}, version {version}."))
    for code, words in _CC.items():
        for version, scope in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic")):
            out.append((f"CC-{code}-{version}", f"Licensed under CC {code} {version}."))
            out.append((f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {words} {version} {scope} License."))
    return out


@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text): the whole licence texts in the folder ``licences``, then headers and notices."""
    folder = files(__package__).joinpath("licences")
    whole = [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in folder.iterdir() if p.name.endswith(".txt")]
    return (*sorted(whole), *_notices())
