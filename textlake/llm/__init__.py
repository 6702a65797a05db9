"""Ten operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Ids are taken as bigint: a column of strings that are numbers will do, one that is no number is an
error of the cast. Input columns whose names an operator does not read play no part in it.
"""
