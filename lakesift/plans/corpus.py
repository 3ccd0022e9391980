"""A small code base in memory: imports that resolve, exports that bear findings, importers that let them out, a cycle, six languages.

The SQL of its queries states the rows that a reader of these files would write down, file by file.
"""

from __future__ import annotations

FILES: dict[str, tuple[str, str]] = {
    "src/model/user.ts": (
        "typescript",
        """import { seal } from '../util/crypt';
export interface Account { id: number; email: string; phone?: string }
export const userEmail = 'nobody@mail.test';
export function loadUser(id: number): Account {
  const row = db.query('select one', id);
  return row;
}
export default class Store {
  private apiKey = 'k-000111';
}
""",
    ),
    "src/util/crypt.ts": (
        "typescript",
        """import Store from '../model/user';
export const password = seal('hunter-22');
export function seal(text: string) {
  return text;
}
""",
    ),
    "src/web/routes.js": (
        "javascript",
        """import Base, { userEmail as mail, loadUser } from '../model/user';
import * as crypt from '../util/crypt';
import express from 'express';
export { seal as lock } from '../util/crypt';
const { phone, name: label } = loadUser(7);
app.get('/me', (req, res) => {
  console.log(mail, req.ip);
  res.json({ body: phone });
});
""",
    ),
    "src/web/index.ts": ("typescript", "import './routes';\nimport { password } from '../util/crypt';\nfetch('/login', { secret: password });\n"),
    "py/people.py": (
        "python",
        '''from .tools import mask, save as store
import logging as log


class Person:
    def __init__(self, ssn, *, email=None):
        self.ssn = ssn
        log.info("made %s", self.ssn)


_hidden = 1
card_number = "4111111111111111"


def pay(total):
    store({"iban": card_number})
''',
    ),
    "py/tools.py": ("python", "from . import people\nfrom os.path import *\n\n\ndef mask(text):\n    return text.lower()\n\n\ndef save(row):\n    requests.post('http://h', json=row)\n"),
    "go/main.go": (
        "go",
        """package main

import (
	"fmt"
	mail "example/mailer"
)

type Guest struct {
	Email string
	token string
}

func Send(guest Guest, passport string) {
	address := guest.Email
	fmt.Println("sent to", address)
	mail.Write(Guest{Email: passport})
}
""",
    ),
    "jv/Order.java": (
        "java",
        """package shop;
import java.util.List;

public class Order {
    private String salary = "none-at-all";

    void print(Order order, int count) {
        String fullName = order.getFullName();
        logger.info(fullName, order.salary);
    }
}
""",
    ),
    "cs/Login.cs": (
        "csharp",
        """using System;
using Json = System.Text.Json;

public class Login {
    string password = "secret-value";

    void Check(string passport) {
        var token = passport.Trim();
        Console.WriteLine(token);
    }
}
""",
    ),
    "broken/half.ts": ("typescript", "const email = read(user.email;\nfunction f( {\n"),
    "broken/half.py": ("python", "def f(:\n    return 1\n"),
}
