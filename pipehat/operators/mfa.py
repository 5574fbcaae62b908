"""Second factors: time-based one-time passwords (RFC 6238) and backup codes."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
import struct
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

STEP, DIGITS, DRIFT, CODES = 30, 6, 1, 10


def code_at(secret: bytes, counter: int, digits: int = DIGITS) -> str:
    """The one-time password of a counter (RFC 4226)."""
    mac = hmac.new(secret, struct.pack(">Q", counter), hashlib.sha1).digest()
    at = mac[-1] & 15
    return str((struct.unpack_from(">I", mac, at)[0] & 0x7FFFFFFF) % 10**digits).zfill(digits)


@dataclass
class SecondFactor:
    """One user's secret and backup codes; a code works once."""

    name: str
    secret: bytes = field(default_factory=lambda: secrets.token_bytes(20))
    clock: Callable[[], float] = time.time
    used: int = -1
    backup: set[str] = field(default_factory=set)

    def uri(self, issuer: str = "pipehat") -> str:
        """What an authenticator app reads."""
        return f"otpauth://totp/{quote(issuer)}:{quote(self.name)}?secret={base64.b32encode(self.secret).decode().rstrip('=')}&issuer={quote(issuer)}&digits={DIGITS}&period={STEP}"

    def verify(self, code: str) -> bool:
        """Whether this is the code of now or of one step before or after, and no earlier one than the last that was taken."""
        now = int(self.clock()) // STEP
        for counter in range(max(0, now - DRIFT, self.used + 1), now + DRIFT + 1):
            if hmac.compare_digest(code_at(self.secret, counter), code):
                self.used = counter
                return True
        return False

    def new_backup_codes(self, n: int = CODES) -> list[str]:
        """Fresh codes, of which only hashes are kept."""
        codes = [secrets.token_hex(5) for _ in range(n)]
        self.backup = {hashlib.sha256(c.encode()).hexdigest() for c in codes}
        return codes

    def use_backup_code(self, code: str) -> bool:
        digest = hashlib.sha256(code.strip().lower().encode()).hexdigest()
        if digest in self.backup:
            self.backup.remove(digest)
            return True
        return False
