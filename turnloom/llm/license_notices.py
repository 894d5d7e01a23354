"""Published licence notices, as plain text. The sentence table and the rules of license_rules are cut from these.

Fixed values: the words of the notices are those that their licences prescribe; identifiers are SPDX short names. A
licence may have several notices; `|` parts the forms of one notice.
"""

from __future__ import annotations

_AS_IS_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_SHORT_AS_IS = _AS_IS_BSD.split("IN NO EVENT")[0]
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so"""
_MIT_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""


def _gnu(name: str, version: str, what: str = "program", later: bool = True) -> str:
    """The notice of a GNU licence; `what` is what the notice calls the work."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation, {which}.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
"""


_GPL, _LGPL, _LIBRARY, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Library General Public License", "GNU Affero General Public License"

NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _MIT_AS_IS),
    ("MIT", _MIT_GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.\n" + _MIT_AS_IS),
    ("MIT-0", _MIT_GRANT + ".\n" + _MIT_AS_IS),
    ("X11", _MIT_GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
     + _MIT_AS_IS.replace("THE AUTHORS OR\nCOPYRIGHT HOLDERS", "THE X CONSORTIUM")),
    ("NCSA", _MIT_GRANT.replace('(the "Software"), to deal in', '(the "Software"), to deal with') + ", subject to the following conditions:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.\n"
     + "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.\n"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file
distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you
under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    ("GPL-3.0-or-later", _gnu(_GPL, "3")),
    ("GPL-2.0-or-later", _gnu(_GPL, "2")),
    ("GPL-3.0-only", _gnu(_GPL, "3", later=False)),
    ("GPL-2.0-only", _gnu(_GPL, "2", later=False)),
    ("LGPL-3.0-or-later", _gnu(_LGPL, "3", "library")),
    ("LGPL-2.1-or-later", _gnu(_LGPL, "2.1", "library")),
    ("LGPL-2.0-or-later", _gnu(_LIBRARY, "2", "library")),
    ("AGPL-3.0-or-later", _gnu(_AGPL, "3")),
    ("AGPL-3.0-only", _gnu(_AGPL, "3", later=False)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/

Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express
or implied. See the License for the specific language governing rights and limitations under the License."""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("CDDL-1.0", """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License."""),
    ("EUPL-1.2", """Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent
versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence."""),
    ("BSD-1-Clause", _BSD + _SOURCE + _AS_IS_BSD),
    ("BSD-2-Clause", _BSD + _SOURCE + _BINARY + _AS_IS_BSD),
    ("BSD-3-Clause", _BSD + _SOURCE + _BINARY + _NAMES + _AS_IS_BSD),
    ("BSD-4-Clause", _BSD + _SOURCE + _BINARY + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n\n"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_AS_IS),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:"""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Artistic-2.0", """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

This license establishes the terms under which a given free software Package may be copied, modified, distributed,
and/or redistributed."""),
    ("PostgreSQL", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the
following two paragraphs appear in all copies."""),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://openfontlicense.org"),
    ("Python-2.0", """This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee")
accessing and otherwise using this software ("Python") in source or binary form and its associated documentation."""),
    ("curl", """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    # Parts of notices that say enough by themselves.
    ("BSD-2-Clause", _BSD + _SOURCE + _BINARY + _SHORT_AS_IS),
    ("BSD-3-Clause", _BSD + _SOURCE + _BINARY + _NAMES + _SHORT_AS_IS),
    ("BSD-3-Clause", _BSD + _SOURCE + _BINARY + _NAMES),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    *((name, _gnu(long, version, later=later).split("\n\n")[0]) for name, long, version, later in (
        ("GPL-3.0-or-later", _GPL, "3", True), ("GPL-2.0-or-later", _GPL, "2", True), ("GPL-3.0-only", _GPL, "3", False), ("GPL-2.0-only", _GPL, "2", False),
        ("LGPL-3.0-or-later", _LGPL, "3", True), ("LGPL-2.1-or-later", _LGPL, "2.1", True), ("LGPL-2.0-or-later", _LIBRARY, "2", True),
        ("AGPL-3.0-or-later", _AGPL, "3", True), ("AGPL-3.0-only", _AGPL, "3", False))),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Names by which texts call licences ("licensed under the ..."), in normal form.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit licence", "mit", "expat license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0", "apache 2 license"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gplv2 or later", "gpl 2 0 or later"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gplv3 or later", "gpl 3 0 or later"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl v2", "gpl 2 0", "gpl version 2"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl v3", "gpl 3 0", "gpl version 3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgplv3", "lgpl v3", "lgpl 3 0"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "gnu agplv3", "agplv3", "agpl v3", "agpl 3 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "ISC": ("isc license", "isc"),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "boost software license"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "CC0-1.0": ("cc0 1 0", "cc0", "public domain under cc0 1 0", "creative commons zero v1 0 universal"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0",),
    "CC-BY-ND-4.0": ("cc by nd 4 0",),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "PostgreSQL": ("postgresql license",),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "Python-2.0": ("python software foundation license version 2", "psf license"),
    "EUPL-1.2": ("european union public licence version 1 2", "eupl version 1 2", "eupl 1 2"),
}
