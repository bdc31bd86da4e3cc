"""Session tokens and password hashes; the engine keeps hashes only."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import secrets

#: Cost of a password hash: scrypt with 2^14 rounds takes 16 MB and some 50 ms.
N, R, P = 1 << 14, 8, 1


def new_token() -> tuple[str, str]:
    """A random session token, and the SHA-256 that sessions keep of it."""
    token = secrets.token_urlsafe(48)
    return token, token_hash(token)


def token_hash(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def password_hash(password: str) -> str:
    salt = os.urandom(16)
    key = hashlib.scrypt(password.encode(), salt=salt, n=N, r=R, p=P)
    return "$".join(["scrypt", str(N), str(R), str(P), *(base64.b64encode(x).decode() for x in (salt, key))])


def password_matches(password: str, stored: str) -> bool:
    """Whether a password has the stored hash; a hash of another form matches nothing."""
    try:
        kind, n, r, p, salt, key = stored.split("$")
        want = base64.b64decode(key)
        got = hashlib.scrypt(password.encode(), salt=base64.b64decode(salt), n=int(n), r=int(r), p=int(p))
    except ValueError:
        return False
    return kind == "scrypt" and hmac.compare_digest(got, want)
