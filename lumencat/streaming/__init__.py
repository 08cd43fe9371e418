"""lumencat.streaming"""
