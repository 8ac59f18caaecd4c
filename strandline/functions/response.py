"""Frequency responses as functions of frequencies in Hz, made to travel with tasks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np

from .kernels import butter


def gain(constant: complex = 1.0):
    return lambda f: np.full(len(f), constant, complex)


def pole_zero(zeros=(), poles=(), constant: complex = 1.0):
    """Poles and zeros in radians per second."""
    def h(f):
        s = 2j * np.pi * np.asarray(f)
        return constant * np.prod([s - z for z in zeros], axis=0) / np.prod([s - p for p in poles], axis=0) if zeros or poles else np.full(len(f), constant, complex)

    return h


def butterworth(corner: float, order: int, kind: str = "low"):
    def h(f):
        s = 1j * np.asarray(f, float) / corner
        if kind == "high":
            s = np.where(s == 0, 1e-300, s)
            s = 1 / s
        return 1 / np.prod([s - np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)], axis=0)

    return h


def differentiation(n: int = 1, constant: float = 1.0):
    return lambda f: constant * (2j * np.pi * np.asarray(f)) ** n


def integration(n: int = 1, constant: float = 1.0):
    def h(f):
        s = 2j * np.pi * np.asarray(f)
        return np.where(s == 0, 0, constant / np.where(s == 0, 1, s) ** n)

    return h


def delay(seconds: float):
    return lambda f: np.exp(-2j * np.pi * np.asarray(f) * seconds)


def sampled(frequencies, values, outside: complex = 0.0):
    """Linear between given values."""
    frequencies, values = np.asarray(frequencies, float), np.asarray(values, complex)

    def h(f):
        out = np.interp(f, frequencies, values.real, outside, outside) + 1j * np.interp(f, frequencies, values.imag, 0, 0)
        return out

    return h


def analog(b, a):
    return lambda f: np.polyval(b, 2j * np.pi * np.asarray(f)) / np.polyval(a, 2j * np.pi * np.asarray(f))


def digital(b, a, deltat: float):
    def h(f):
        z = np.exp(-2j * np.pi * np.asarray(f) * deltat)
        return np.polyval(b[::-1], z) / np.polyval(a[::-1], z)

    return h


def digital_butterworth(corner: float, order: int, deltat: float, kind: str = "lowpass"):
    b, a = butter(order, [2 * deltat * corner], kind)
    return digital(b, a, deltat)


def multiply(*responses):
    return lambda f: reduce(lambda p, q: p * q, (r(f) for r in responses), np.ones(len(f), complex))


def inverse(response):
    def h(f):
        v = np.asarray(response(f), complex)
        return np.where(v == 0, 0, 1 / np.where(v == 0, 1, v))

    return h


#: Steps from one quantity to another: how many times it is differentiated.
QUANTITIES = {"displacement": 0, "velocity": 1, "acceleration": 2}


def converter(source: str, target: str):
    n = QUANTITIES[target] - QUANTITIES[source]
    return differentiation(n) if n > 0 else integration(-n) if n < 0 else gain()
