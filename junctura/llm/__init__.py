"""Training-data operators: thirteen distributed transformations over document tables.

Every module holds one operator; ``queries`` registers them for the driver.
"""
