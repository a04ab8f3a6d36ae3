"""Column-expression builders (masks, tokenizer, token classes, similarity).

Everything here returns SQL expression text or ``Column`` objects that run
inside Spark's JVM; nothing here touches data on the driver.
"""
