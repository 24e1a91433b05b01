"""Access masks: levels, labels, single-bit flags, inheritance scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

# File system access mask bits.
BITS = {
    "ListDirectory": 0x1, "CreateFiles": 0x2, "CreateDirectories": 0x4, "ReadExtendedAttributes": 0x8,
    "WriteExtendedAttributes": 0x10, "Traverse": 0x20, "DeleteSubdirectoriesAndFiles": 0x40,
    "ReadAttributes": 0x80, "WriteAttributes": 0x100, "Delete": 0x10000, "ReadPermissions": 0x20000,
    "ChangePermissions": 0x40000, "TakeOwnership": 0x80000, "Synchronize": 0x100000,
}
READ = 0x20089
WRITE = 0x116
READ_EXECUTE = 0x200A9
MODIFY = 0x301BF
FULL = 0x1F01FF
SYNCHRONIZE = 0x100000
WRITE_OR_CHANGE = WRITE | 0x10000 | 0x40 | 0x40000 | 0x80000
CONTAINER_INHERIT, OBJECT_INHERIT = 1, 2
NO_PROPAGATE, INHERIT_ONLY = 1, 2

SCOPES = {
    (3, 0): "This folder, subfolders and files",
    (0, 0): "This folder only",
    (1, 0): "This folder and subfolders",
    (2, 0): "This folder and files",
    (3, 2): "Subfolders and files only",
    (1, 2): "Subfolders only",
    (2, 2): "Files only",
}


def has_all(rights: Column | str, mask: int) -> Column:
    return col(rights).bitwiseAND(mask) == mask


def has_any(rights: Column | str, mask: int) -> Column:
    return col(rights).bitwiseAND(mask) != 0


def without_synchronize(rights: Column | str) -> Column:
    return col(rights).bitwiseAND(~SYNCHRONIZE)


def same_rights(left: Column | str, right: Column | str) -> Column:
    return without_synchronize(left) == without_synchronize(right)


def level(rights: Column | str) -> Column:
    """Permission level; any write, delete or change bit short of Modify is Custom."""
    r = col(rights)
    return (
        F.when(has_all(r, FULL), "FullControl").when(has_all(r, MODIFY), "Modify")
        .when(has_any(r, WRITE_OR_CHANGE), "Custom").when(has_all(r, READ_EXECUTE), "ReadAndExecute")
        .when(has_all(r, READ) | has_all(r, BITS["ListDirectory"]), "Read")
        .when(without_synchronize(r) != 0, "Custom").otherwise("None")
    )


def friendly(rights: Column | str) -> Column:
    r = col(rights)
    return (
        F.when(has_all(r, FULL), "Full Control").when(has_all(r, MODIFY), "Modify (Read/Write/Delete)")
        .when(has_all(r, READ_EXECUTE), "Read & Execute").when(has_all(r, READ), "Read Only")
        .when(has_all(r, WRITE), "Write Only").otherwise(r.cast("string"))
    )


def basic(rights: Column | str) -> Column:
    r = col(rights)
    return (
        F.when(has_all(r, FULL), "Full Control").when(has_all(r, MODIFY), "Modify")
        .when(has_all(r, READ_EXECUTE), "Read & Execute").when(has_all(r, READ), "Read")
        .when(has_all(r, WRITE), "Write").otherwise("Custom Rights")
    )


def flags(rights: Column | str) -> list[Column]:
    """Fourteen boolean columns, one per access bit."""
    return [has_all(rights, bit).alias(name) for name, bit in BITS.items()]


def applies_to(inherit: Column | str, propagate: Column | str) -> Column:
    """Scope label; propagation counts only for its inherit-only bit, unknown pairs mean everything."""
    i, p = col(inherit), col(propagate)
    out = F.when(F.lit(False), "")
    for (want_i, want_p), label in SCOPES.items():
        test = has_all(p, INHERIT_ONLY) if want_p else (p == 0)
        out = out.when((i == want_i) & test, label)
    return out.when(i == 0, SCOPES[(0, 0)]).otherwise(SCOPES[(3, 0)])


def from_applies_to(label: Column | str) -> Column:
    """``struct(inherit_flags, prop_flags)`` of a scope label; unknown labels mean everything."""
    text = F.lower(F.trim(col(label)))
    pair = lambda i, p: F.struct(F.lit(i).alias("inherit_flags"), F.lit(p).alias("prop_flags"))
    out = F.when(F.lit(False), pair(3, 0))
    for (i, p), name in SCOPES.items():
        out = out.when(text == name.lower(), pair(i, p))
    return out.otherwise(pair(3, 0))


def delta(before: Column | str, after: Column | str) -> Column:
    """Text of the rights gained (+) and lost (-)."""
    b, a = col(before), col(after)
    added, removed = a.bitwiseAND(F.bitwise_not(b)), b.bitwiseAND(F.bitwise_not(a))

    def parts(bits: Column, sign: str, full: Column) -> list[Column]:
        read = F.when(has_all(bits, READ_EXECUTE), f"{sign}Read & Execute").when(has_all(bits, READ), f"{sign}Read")
        single = [
            F.when(has_all(bits, MODIFY), f"{sign}Modify"),
            F.when(has_any(bits, BITS["Delete"] | BITS["DeleteSubdirectoriesAndFiles"]), f"{sign}Delete"),
            F.when(has_all(bits, WRITE), f"{sign}Write"), read,
        ]
        return [F.when(full, f"{sign}Full Control")] + [F.when(~full, s) for s in single]

    listed = F.array_compact(F.array(*parts(added, "+", has_all(a, FULL)), *parts(removed, "-", has_all(removed, FULL))))
    return F.when(b == a, "No difference").when(F.size(listed) > 0, F.array_join(listed, ", ")).otherwise("Bit change")
