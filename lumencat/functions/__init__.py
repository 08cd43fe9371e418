"""lumencat.functions"""
