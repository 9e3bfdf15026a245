"""Whole plans: conversion and inspection of many publications at once."""

from .convert import convert, inspect_books

__all__ = ["convert", "inspect_books"]
