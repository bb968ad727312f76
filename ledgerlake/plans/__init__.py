"""Registered queries."""


def registries():
    from ledgerlake.plans import incoming, inputs, rules, scalars, spend

    return [spend.R, rules.R, inputs.R, incoming.R, scalars.R]
