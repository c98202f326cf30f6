"""Small sources in many languages, and the symbols that stand in them; K stands for a key."""

from __future__ import annotations

#: By the ending of the file: its text, and (symbol, kind, first line, last line) of each symbol.
SOURCES: dict[str, tuple[str, list[tuple[str, str, int, int]]]] = {
    "py": (
        """\
import os

class Box(Base):
    def open_K(self):
        return helper_K(1)


def helper_K(x):
    return x
""",
        [("Box", "class", 3, 5), ("Box::open_K", "method", 4, 5), ("helper_K", "function", 8, 9)],
    ),
    "rs": (
        """\
use std::io;

pub struct Box {
    a: i32,
}

impl Box {
    pub fn open_K(&self) -> i32 {
        helper_K(1)
    }
}

fn helper_K(x: i32) -> i32 {
    x
}
""",
        [("Box", "struct", 3, 5), ("Box::open_K", "method", 8, 10), ("helper_K", "function", 13, 15)],
    ),
    "go": (
        """\
package main

type Box struct {
	A int
}

func (b *Box) OpenK() int {
	return helperK(1)
}

func helperK(x int) int {
	return x
}
""",
        [("Box", "struct", 3, 5), ("Box::OpenK", "method", 7, 9), ("helperK", "function", 11, 13)],
    ),
    "java": (
        """\
package a;

public class Box extends Base {
    public int openK() {
        return helperK(1);
    }

    private int helperK(int x) {
        return x;
    }
}
""",
        [("Box", "class", 3, 11), ("Box::openK", "method", 4, 6), ("Box::helperK", "method", 8, 10)],
    ),
    "ts": (
        """\
export class Box extends Base {
  openK(): number {
    return helperK(1);
  }
}

export function helperK(x: number): number {
  return x;
}
""",
        [("Box", "class", 1, 5), ("Box::openK", "method", 2, 4), ("helperK", "function", 7, 9)],
    ),
    "js": (
        """\
class Box extends Base {
  openK() {
    return helperK(1);
  }
}

function helperK(x) {
  return x;
}
""",
        [("Box", "class", 1, 5), ("Box::openK", "method", 2, 4), ("helperK", "function", 7, 9)],
    ),
    "c": (
        """\
#include <stdio.h>

struct box {
  int a;
};

static int helper_K(int x) {
  return x;
}

int open_K(struct box *b) {
  return helper_K(b->a);
}
""",
        [("box", "struct", 3, 5), ("helper_K", "function", 7, 9), ("open_K", "function", 11, 13)],
    ),
    "cpp": (
        """\
class Box : public Base {
 public:
  int openK() {
    return helperK(1);
  }
};

int helperK(int x) {
  return x;
}
""",
        [("Box", "class", 1, 6), ("Box::openK", "method", 2, 5), ("helperK", "function", 8, 10)],
    ),
    "cs": (
        """\
namespace A {
  public class Box : Base {
    public int OpenK() {
      return HelperK(1);
    }

    private int HelperK(int x) {
      return x;
    }
  }
}
""",
        [("A::Box", "class", 2, 10), ("A::Box::OpenK", "method", 3, 5), ("A::Box::HelperK", "method", 7, 9)],
    ),
    "kt": (
        """\
class Box : Base() {
    fun openK(): Int {
        return helperK(1)
    }
}

fun helperK(x: Int): Int {
    return x
}
""",
        [("Box", "class", 1, 5), ("Box::openK", "method", 2, 4), ("helperK", "function", 7, 9)],
    ),
    "swift": (
        """\
class Box: Base {
    func openK() -> Int {
        return helperK(1)
    }
}

func helperK(x: Int) -> Int {
    return x
}
""",
        [("Box", "class", 1, 5), ("Box::openK", "method", 2, 4), ("helperK", "function", 7, 9)],
    ),
    "scala": (
        """\
class Box extends Base {
  def openK(): Int = {
    helperK(1)
  }

  def helperK(x: Int): Int = {
    x
  }
}
""",
        [("Box", "class", 1, 9), ("Box::openK", "method", 2, 4), ("Box::helperK", "method", 6, 8)],
    ),
    "rb": (
        """\
class Box < Base
  def open_K
    helper_K(1)
  end

  def helper_K(x)
    x
  end
end
""",
        [("Box", "class", 1, 9), ("Box::open_K", "method", 2, 4), ("Box::helper_K", "method", 6, 8)],
    ),
    "php": (
        """\
<?php
class Box extends Base {
  public function openK() {
    return helperK(1);
  }
}

function helperK($x) {
  return $x;
}
""",
        [("Box", "class", 2, 6), ("Box::openK", "method", 3, 5), ("helperK", "function", 8, 10)],
    ),
    "dart": (
        """\
class Box extends Base {
  int openK() {
    return helperK(1);
  }
}

int helperK(int x) {
  return x;
}
""",
        [("Box", "class", 1, 5), ("Box::openK", "method", 2, 4), ("helperK", "function", 7, 9)],
    ),
    "lua": (
        """\
function helper_K(x)
  return x
end

function open_K()
  return helper_K(1)
end
""",
        [("helper_K", "function", 1, 3), ("open_K", "function", 5, 7)],
    ),
    "ex": (
        """\
defmodule Box do
  def open_K(x) do
    helper_K(x)
  end

  defp helper_K(x) do
    x
  end
end
""",
        [("Box", "class", 1, 9), ("Box::open_K", "method", 2, 4), ("Box::helper_K", "method", 6, 8)],
    ),
    "sh": (
        """\
helper_K() {
  echo "$1"
}

open_K() {
  helper_K 1
}
""",
        [("helper_K", "function", 1, 3), ("open_K", "function", 5, 7)],
    ),
    "R": (
        """\
helper_K <- function(x) {
  x
}

open_K <- function(y) {
  helper_K(y)
}
""",
        [("helper_K", "function", 1, 3), ("open_K", "function", 5, 7)],
    ),
    "zig": (
        """\
fn helperK(x: i32) i32 {
    return x;
}

pub fn openK() i32 {
    return helperK(1);
}
""",
        [("helperK", "function", 1, 3), ("openK", "function", 5, 7)],
    ),
}
