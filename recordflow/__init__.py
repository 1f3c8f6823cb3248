"""Pipelines over keyed record sets, as plain DataFrame transformations."""
