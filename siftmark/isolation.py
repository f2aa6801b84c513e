"""A guard for the driver's process: inside it, sockets reach this machine only. Executors are not guarded; they open no sources."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterator
from contextlib import contextmanager


class NetworkBlocked(ConnectionError):
    """A connection to another machine was tried inside the guard."""


def is_loopback(address: object) -> bool:
    """Whether a socket address stays on this machine: a local path, ``localhost``, or an IP address of a loopback network."""
    if isinstance(address, str | bytes):
        return True  # a Unix socket
    host = address[0] if isinstance(address, tuple) and address else None
    if not isinstance(host, str):
        return False
    if host.lower().rstrip(".") == "localhost":
        return True
    try:
        ip = ipaddress.ip_address(host.partition("%")[0])
    except ValueError:
        return False
    return (getattr(ip, "ipv4_mapped", None) or ip).is_loopback


@contextmanager
def isolated() -> Iterator[list[str]]:
    """Refuse connections to other machines; yields the list of what was refused."""
    refused: list[str] = []
    kept = {name: getattr(socket.socket, name) for name in ("connect", "connect_ex", "sendto")}

    def guarded(name: str):
        def call(self: socket.socket, *args: object):
            address = args[-1]
            if not is_loopback(address):
                refused.append(str(address))
                raise NetworkBlocked(f"no connection to {address} here")
            return kept[name](self, *args)

        return call

    for name in kept:
        setattr(socket.socket, name, guarded(name))
    try:
        yield refused
    finally:
        for name in kept:
            if name in vars(socket.socket):
                delattr(socket.socket, name)


def self_test() -> bool:
    """Whether the guard stops a connection to a documentation address, which no machine has."""
    with isolated() as refused, socket.socket() as s:
        try:
            s.connect(("192.0.2.1", 9))
        except NetworkBlocked:
            return refused == ["('192.0.2.1', 9)"]
        except OSError:
            return False
    return False
