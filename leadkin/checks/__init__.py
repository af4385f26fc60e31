"""Queries over the driver's tables, each with equivalent SQL where SQL can express it."""


def load() -> dict:
    from leadkin.checks import building, contacts, mail, roles, similarity  # noqa: F401

    return roles.REGISTRY
