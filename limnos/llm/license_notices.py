"""Short license texts and standard notices by license; the long texts lie in ``license_texts``.

``BSD`` names texts that hold no more than what all BSD licenses share.
"""

from __future__ import annotations

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ADVERT = ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
           "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")
_HOLDERS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
            "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_MIT_KEEP = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = (" THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
            "OTHER DEALINGS IN THE SOFTWARE.")
_ISC_END = (" THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
            "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")


def _gnu(name: str, version: str) -> list[str]:
    """Notices of a GNU license: the standard headers of this version only and of later ones too, and short forms."""
    free = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU " + name
    return [f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name} version {version}.", f"Released under the GNU {name} v{version}.",
            f"it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or",
            f"{free} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
            f"{free} as published by the Free Software Foundation, version {version}.", f"{free} version {version} as published by the Free Software Foundation."]


def _commons(code: str, name: str, version: str, port: str) -> list[str]:
    return [f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {name} {version} {port} License."]


NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT.split(" (the")[0], _MIT + _MIT_KEEP + _MIT_END],
    "MIT-0": [_MIT + "." + _MIT_END],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
            "appear in all copies." + _ISC_END],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_END],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD + _HOLDERS],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD + _ENDORSE + _HOLDERS],
    "BSD-4-Clause": ["Licensed under the BSD 4-Clause License.", _BSD + _ADVERT + _HOLDERS],
    "GPL-1.0": _gnu("General Public License", "1"), "GPL-2.0": _gnu("General Public License", "2"), "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-2.0": _gnu("Library General Public License", "2"), "LGPL-2.1": _gnu("Lesser General Public License", "2.1"), "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    **{f"CC-{code}-{v}": _commons(code, name, v, port) for v, port in (("4.0", "International"), ("3.0", "Unported"))
       for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives" if v == "4.0" else "Attribution-NoDerivs"), ("BY-NC", "Attribution-NonCommercial"),
                          ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives" if v == "4.0" else "Attribution-NonCommercial-NoDerivs"))},
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                  "purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
             "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
             "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
             "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
                "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "All-Rights-Reserved": ["All rights reserved."],
}
