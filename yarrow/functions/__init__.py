"""yarrow.functions"""
