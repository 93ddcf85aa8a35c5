"""siltstone.functions"""
